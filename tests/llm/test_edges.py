"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns, skew."""

import random
import zlib
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pytest
from brute import components, word_library
from pyspark.sql import functions as F

import corpus_pipeline
from jobweave.llm import bpe, exact_dedup, language_id, mixing, near_dedup, preference, quality, shared, token_files, toxicity, url_filter
from jobweave.llm.queries import WORD_TOKENIZER

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, size string, _h1 string, node string, text_ string"


def words(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def rows():
    long_text = words(1, 30_000, 100_000)
    texts = [
        None, "", "  \n\t ", "One Two three", "one two THREE", "one two three", words(2, 60), words(2, 60), words(2, 58), long_text,
        long_text + " more", "Été à la ÉCOLE, n'est-ce pas?", "ß ſ İ Σ \x1c x", "<|endoftext|> a", "12 34 #*$", words(3, 40), words(3, 40).upper(),
    ]
    out = [(i, t, None if i % 5 == 4 else "en", None if i % 4 == 3 else f"s{i % 3}", len(t or ""), "a", "b", "c", "d", "e") for i, t in enumerate(texts)]
    return [*out, out[5], out[6], (None, "no key", "en", "s1", 6, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_exact(docs, none):
    got = exact_dedup.exact_groups(docs).collect()
    want = {}
    for r in rows():
        want.setdefault((r[1] or "").encode().lower(), []).append(r[0])
    assert len(got) == len(rows())
    assert sorted(r.group_size for r in got) == sorted(len(g) for g in want.values() for _ in g)
    best = {k: max((x for x in g if x is not None), default=None) for k, g in want.items()}
    ids = {r[0]: best[(r[1] or "").encode().lower()] for r in rows() if r[0] is not None}
    assert all(r.keep_id == ids[r.doc_id] for r in got if r.doc_id is not None)
    assert sum(r.kept for r in got) == len(want)  # of repeated rows one
    assert exact_dedup.exact_groups(none).count() == 0
    assert exact_dedup.exact_groups(docs, max_bytes=100).select("doc_id", "keep_id", "group_size", "sha256").exceptAll(
        exact_dedup.exact_groups(docs).select("doc_id", "keep_id", "group_size", "sha256")).count() == 0


def test_grace_levels():
    """Contents that share all their hash bits still part, and copies take no room."""
    records = [(7, f"text {i % 40}".encode(), i, i, 1) for i in range(400)]
    out = list(exact_dedup.grace_groups(records, max_bytes=250))
    groups = [o for o in out if o[0] == "group"]
    assert len(groups) == 40 and all(g[6] == 10 and g[4] == 360 + int(g[3].split()[1]) for g in groups)
    assert sorted(o[1] for o in out if o[0] == "member") == list(range(400))


def test_near(docs, none):
    want = components([(r[0], r[1]) for r in rows() if r[0] is not None], 2)
    got = near_dedup.near_groups(docs, forest=near_dedup.Forest(words=2)).collect()
    assert len(got) == len(rows())
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], want[r.doc_id][1] == r.doc_id)
    assert near_dedup.near_groups(none).count() == 0


@pytest.mark.parametrize("reach", [1, 12])
def test_near_families(spark, reach):
    """Large families of edited copies, whose regions hold more than their orders let meet: no link is lost."""
    out, r = [], random.Random(5)
    for family in range(3):
        base = words(100 + family, 120, 5_000).split()
        for _ in range(90):
            copy = list(base)
            for at in r.sample(range(len(base)), r.randrange(0, 14)):
                copy[at] = f"x{r.randrange(10**6)}"
            out.append((len(out), " ".join(copy)))
    found = near_dedup.near_groups(spark.createDataFrame(out, "doc_id long, text string"), forest=near_dedup.Forest(words=2, reach=reach))
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in found.collect()} == components(out, 2)


def test_different_words_stay_apart(spark):
    """Words of two letters whose sums over powers agree modulo 2^64 are different words."""
    bits = [bin(i).count("1") % 2 for i in range(1 << 10)]
    words_ = ["".join("ab"[b ^ k] for b in bits) for k in (0, 1)]
    got = near_dedup.near_groups(spark.createDataFrame([(1, words_[0]), (2, words_[1]), (3, words_[1].upper())], "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 2, 3: 2}


def test_pairs_come_from_the_orders(spark, sf_dir):
    """On the given table: regions hold sets, the orders make them meet, and those pairs hold the links."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = spark.createDataFrame([("r", b"k1", b"a", 10), ("r", b"k2", b"b", 10), ("r", b"k3", b"c", 10), ("r", b"k4", b"d", 10), ("s", b"k1", b"e", 10), ("s", b"k9", b"f", 5)],
                                 "region string, order_key binary, node binary, n long").withColumn("region", F.xxhash64("region"))
    pairs, crowded = near_dedup._candidates(rows, near_dedup.Forest(reach=2))
    assert {(bytes(p.a), bytes(p.b)) for p in pairs.collect()} == {(b"a", b"b"), (b"a", b"c"), (b"b", b"c"), (b"b", b"d"), (b"c", b"d")}
    assert {bytes(r.node) for r in crowded.collect()} == {b"a", b"b", b"c", b"d"}
    assert near_dedup.near_groups(docs).where("not kept").count() > 0


def test_components(spark):
    chain = [(f"{i:04d}".encode(), f"{i + 1:04d}".encode()) for i in range(300)] + [(b"9000", b"9001"), (b"9002", b"9001"), (b"9001", b"9000")]
    got = {bytes(r.node): bytes(r.root) for r in near_dedup.components(spark.createDataFrame(chain, "a binary, b binary")).collect()}
    assert len(got) == 304 and all(v == (b"0000" if k < b"9" else b"9000") for k, v in got.items())
    assert near_dedup.components(spark.createDataFrame([], "a binary, b binary")).count() == 0


def test_quality(docs, none):
    got = quality.judge(docs)
    assert got.columns[:9] == ["doc_id", "text", "lang", "source", "n_chars", "size", "_h1", "node", "text_"]
    found = {r.doc_id: r for r in got.collect()}
    assert found[0].n_words == found[1].n_words == found[2].n_words == 0 and not found[0].kept
    assert found[9].n_words == 30_000 and found[9].kept and found[14].n_symbols == 3 and found[3]._h1 == "c"
    assert quality.judge(none).count() == 0


def test_frequent_lines(spark):
    """A line of many different texts of one host goes there; copies and other hosts do not count."""
    line = "Subscribe  to our   NEWSLETTER"
    out = [(i, f"{words(i, 30, 9999)}\n{line}\n{words(500 + i, 30, 9999)}", None, "a", 0) for i in range(1, 31)]
    out += [(100 + i, f"{words(1000, 30, 9999)}\nsame {line}", None, "b", 0) for i in range(40)]
    out += [(200, f"{line}\n" * 3 + "short rest", None, "a", 0), (201, f"{words(7, 30, 9999)}\n{line}", None, "c", 0), (202, words(8, 30), None, None, 0)]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(out, "doc_id long, text string, lang string, source string, n_chars long")).collect()}
    assert all(got[i].n_words_left == 60 and line not in got[i].cleaned_text and got[i].kept for i in range(1, 31))
    assert got[200].n_words_left == 2 and not got[200].kept
    assert all(got[k].cleaned_text == got[k].text and got[k].kept for k in (*range(100, 140), 201, 202))


def test_frequent_lines_on_a_large_host(spark):
    """The number of texts decides, however many the host has: a line of 25 of 500 goes."""
    line = "Read more on our site"
    out = [(i, f"{words(i, 30, 9999)}\n{line}" if i % 20 == 0 else words(i, 30, 9999), "a") for i in range(500)]
    out += [(1000 + i, f"{line}\n" * 12 + words(2000 + i, 12, 9999), "a") for i in range(3)] + [(2000, f"{words(9, 30, 9999)}\n{line}", "b")]
    df = spark.createDataFrame(out, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in quality.judge(df, rules=quality.LineRules(max_repeat_percent=100)).collect()}
    assert all(got[i].n_words_left == 30 and line not in got[i].cleaned_text and got[i].kept for i in range(0, 500, 20))
    assert all(got[1000 + i].n_words_left == 12 and not got[1000 + i].kept for i in range(3))
    assert got[2000].cleaned_text == got[2000].text


def test_repeat_words(spark):
    block = "a b c d e f"
    texts = ["a b c d e f g", f"{block} x {block}", "x " * 12, f"{block} {words(4, 50)} {block} {block}"]
    from collections import Counter
    want = []
    for t in texts:
        w = t.split()
        grams = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
        c = Counter(grams)
        want.append(len({j for i, g in enumerate(grams) if c[g] > 1 for j in range(i, i + 5)}))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.n_repeat_words for r in quality.base_measures(df).orderBy("doc_id").collect()] == want


def test_repeat_words_of_close_hashes(spark):
    """The hashes of the two windows agree in their upper 40 bits; the other lies between two equal ones."""
    pairs = [("n259557", "n1746543"), ("n546209", "n1620421"), ("n936800", "n2103934")]
    texts = [f"{a} b c d e {words(1, 20, 10**6)} {b} b c d e {words(2, 20, 10**6)} {a} b c d e" for a, b in pairs]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.n_repeat_words for r in quality.base_measures(df).collect()] == [10, 10, 10]


def test_mix_writes_its_documents_once(docs, monkeypatch):
    written = []
    monkeypatch.setattr(mixing, "stash", lambda df, name: written.append(name) or shared.stash(df, name))
    assert mixing.mix(docs).count() == docs.count()
    assert written == ["mix_sizes", "mix_targets", "pareto_cuts"]


def test_mixing(docs, none):
    got = mixing.mix(docs)
    again = mixing.mix(docs.repartition(5))
    columns = ["doc_id", "size", "source_size", "target", "times", "taken"]
    assert got.select(columns).exceptAll(again.select(columns)).count() == 0 and got.count() == len(rows())
    assert all(r.taken <= 3 * r.size and r.taken == r.times * r.size for r in got.collect())
    assert mixing.mix(none).count() == 0


def test_targets_and_sample(spark):
    r = random.Random(2)
    out = [(i, "w " * r.randrange(5, 60), "abcdefg"[min(6, int(r.expovariate(0.6)))]) for i in range(4000)]
    df = spark.createDataFrame(out, "doc_id long, text string, source string")
    per = {x.source: x for x in mixing.mix(df).groupBy("source").agg(
        F.sum("taken").alias("taken"), F.first("target").alias("target"), F.first("source_size").alias("size"), F.max("size").alias("longest")).collect()}
    for s in per.values():
        assert abs(s.taken - s.target) <= 60 and s.target <= 3 * s["size"] + 1e-6
    assert abs(sum(s.target for s in per.values()) - sum(s["size"] for s in per.values())) < 1e-3


def test_pareto_unequal(spark):
    """Items with larger fractions are taken more often; certain copies always come."""
    df = spark.range(4000).withColumns({"g": F.lit("x"), "size": F.lit(1).cast("long"), "copies": F.when(F.col("id") % 2 == 0, 0.2).otherwise(1.7)})
    got = mixing.pareto_sample(df, "g", "size", "copies", mixing.uniform("id"), ["id"])
    per = {x.odd: x.t for x in got.groupBy((F.col("id") % 2).alias("odd")).agg(F.avg("times").alias("t")).collect()}
    assert abs(per[0] - 0.2) < 0.04 and abs(per[1] - 1.7) < 0.04
    assert got.agg(F.sum("times")).first()[0] == 2000 + 1800


def test_encoding(docs, none):
    library = word_library()
    for r in bpe.encode_decode(docs.withColumn("ids", F.lit("x")), WORD_TOKENIZER, most=50).join(
            docs.select("doc_id", "text").distinct(), "doc_id").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == library.decode(ids, skip_special_tokens=False)
    assert bpe.encode_decode(none, WORD_TOKENIZER).count() == 0


def test_last_stage_returns_the_corpus(docs):
    """The encoded corpus itself comes out: ids, source and language of every row, repeated ones too."""
    library = word_library()
    got = corpus_pipeline.encode(None, docs, "").collect()
    want = [(r[0], library.encode(r[1] or "", add_special_tokens=False).ids, r[3], r[2]) for r in rows()]
    assert sorted(map(repr, ((r.doc_id, r.ids, r.source, r.lang) for r in got))) == sorted(map(repr, want))


def test_fuzzed_texts_encode_like_the_library():
    library, merges, r = word_library(), bpe.Merges(WORD_TOKENIZER), random.Random(3)
    letters = [*"abcXYZ  \t\n.,'<>|12", *map(chr, (0xE9, 0x301, 0xC5, 0x3A3, 0x3C2, 0x130, 0xDF, 0x65E5, 0x1C, 0x85, 0xA0, 0x2003, 0x200B, 0x345, 0x1F600)),
               "<|endoftext|>", "'s", "'LL"]
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(60))) for _ in range(3000)] + ["a" * 5000, "ab" * 300 + "'s"]
    some = sorted({w for t in texts[:500] for c in bpe.chunks_of(t) for w in merges.parts(c) if isinstance(w, bytes)})
    lexicon = bpe.Lexicon.compile(some, merges.merge_words(some))
    assert lexicon.numbers(some).tolist() == list(range(len(some)))
    assert lexicon.numbers([b"", b"zzzzz", some[3] + b"q"]).tolist() == [-1, -1, -1]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    plain = [t for t in texts if "\x1c" not in t]
    for some, ids in ((texts, want), (plain, [i for t, i in zip(texts, want) if "\x1c" not in t])):
        got, lengths = bpe.Encoder(merges, lexicon).encode(pa.array(some))
        assert got.tolist() == [i for x in ids for i in x] and lengths.tolist() == [len(x) for x in ids]
        got, lengths = token_files.encode_texts(pa.array(some), WORD_TOKENIZER, 2)
        assert got.tolist() == [i for x in ids for i in [*x, 2]] and lengths.tolist() == [len(x) + 1 for x in ids]


def test_words_before_marks_are_no_odd_pieces(monkeypatch):
    """Words of letters, with marks behind them or not, are counted and encoded as arrays; only other pieces are cut one at a time."""
    library, seen, parts = word_library(), [], bpe.Merges.parts
    merges = bpe.Merges(WORD_TOKENIZER)
    texts = ["Été, à la&&& ÉCOLE.### ciónñ%%% n'est it's.", None, "", " été  été\n4.0. ×, ÷* straße$$$ <|endoftext|>,x", "the the, The!! " * 50 + "a" * 5000 + "."]
    want = Counter(w for t in texts for c in bpe.chunks_of(t or "") for w in merges.parts(c) if isinstance(w, bytes))
    monkeypatch.setattr(bpe.Merges, "parts", lambda self, chunk: seen.append(chunk) or parts(self, chunk))
    got = Counter()
    for batch in bpe._count_words(iter([pa.RecordBatch.from_arrays([pa.array(texts[:3])], names=["text"]), pa.RecordBatch.from_arrays([pa.array(texts[3:])], names=["text"])]), WORD_TOKENIZER):
        for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            got[word] += n
    assert got == want
    odd = {",", "&&&", ".###", "###", ".", "%%%", "n'est", "it's", "4.0.", "×,", "÷*", "$$$", "<|endoftext|>,x", "!!", ""}
    assert set(seen) <= odd
    words = sorted(want)[::2]
    encoder = bpe.Encoder(merges, bpe.Lexicon.compile(words, merges.merge_words(words)))
    ids, lengths = encoder.encode(pa.array([t or "" for t in texts]))
    assert set(seen) <= odd
    found = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert ids.tolist() == [i for x in found for i in x] and lengths.tolist() == [len(x) for x in found]
    decoded = merges.decode_lists(np.concatenate([[0], np.cumsum(lengths)]), ids).to_pylist()
    assert decoded == [library.decode(x, skip_special_tokens=False) for x in found] == [merges.decode(x) for x in found]


def test_fuzzed_marks_encode_like_the_library():
    library, merges, r = word_library(), bpe.Merges(WORD_TOKENIZER), random.Random(5)
    letters = [*"abEst  \n.,;:!?#$%&*'<>|_-7", *"éÉñßÿ×÷ªµΣ", "\u0301", "\u0338", "\u037e", "\xa0", "<|endoftext|>", "'s"]
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(40))) for _ in range(4000)]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    encoder = bpe.Encoder(merges, bpe.Lexicon.compile([], []))
    for _ in range(2):  # from memory the second time
        got, lengths = encoder.encode(pa.array(texts))
        assert got.tolist() == [i for x in want for i in x] and lengths.tolist() == [len(x) for x in want]
    got, lengths = token_files.encode_texts(pa.array(texts), WORD_TOKENIZER, 2)
    assert got.tolist() == [i for x in want for i in [*x, 2]] and lengths.tolist() == [len(x) + 1 for x in want]


def test_shared_suffixes():
    """Words that end alike share their last states."""
    some = [a + b for a in (b"start", b"stop", b"walk") for b in (b"", b"ed", b"ing")]
    lexicon = bpe.Lexicon.compile(sorted(some), [b"\1\0\0\0"] * len(some))
    alone = bpe.Lexicon.compile([b"walk", b"walked", b"walking"], [b"\1\0\0\0"] * 3)
    assert len(lexicon.final) == len(alone.final) + len(["s", "st", "sta", "star", "sto"])
    assert bytes(lexicon.to_bytes())


@pytest.mark.parametrize("delta", [False, True])
def test_token_files(spark, docs, none, tmp_path, delta):
    library, out = word_library(), str(tmp_path / "t")
    keyed = docs.where("doc_id is not null")
    token_files.write_tokens(keyed, out, WORD_TOKENIZER, 2, delta=delta)
    files, start = token_files.read_tokens(spark, out), 0
    got = sorted(token_files.read_checked(files).collect(), key=lambda r: (r.doc_id, r.start))
    for r, row in zip(got, sorted((x for x in rows() if x[0] is not None), key=lambda x: x[0])):
        ids = [*library.encode(row[1] or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (row[0], start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids)))
        start += len(ids)
    meta = token_files.documents_at(files)
    assert "array<int>" not in meta._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1].split("\n")[0]
    assert [r.start for r in meta.orderBy("start").collect()] == [r.start for r in got]
    assert {r.doc_id for r in token_files.tokens_of(files, 3, 5).collect()} == {3, 4, 5}
    token_files.write_tokens(none, out + "0", WORD_TOKENIZER, 2)
    assert token_files.read_checked(token_files.read_tokens(spark, out + "0")).count() == 0


def test_language(docs, none, spark):
    model = language_id.train(docs)
    got = language_id.predict(docs, model).collect()
    assert len(got) == len(rows()) and {r.lang_pred for r in got} == {"en", "und"}
    assert all((r.lang_pred == "und") == (r.doc_id in (0, 1, 2, None) or r.score == 0) for r in got if r.doc_id is not None)
    assert language_id.predict(docs, language_id.train(none)).where("lang_pred <> 'und' or score <> 0").count() == 0
    assert language_id.predict(none, model).count() == 0


def test_toxicity_held_out(spark, docs, none):
    r, out, labels = random.Random(1), [], []
    for i in range(600):
        toxic, poor = r.random() < 0.3, r.random() < 0.3
        text = words(i, 60) + (f" {r.choice(['scum', 'idiot', 'loser'])}" if toxic else "") + (" click here" if poor else "")
        out.append((i, text))
        labels.append((i, int(poor), int(toxic)))
    every = spark.createDataFrame(out, "doc_id long, text string")
    marked = spark.createDataFrame([*labels[:400], labels[0], (None, 1, 1), (5000, None, 1)], "doc_id long, poor int, toxic int")
    chain = toxicity.train_chain(every, marked, ("poor", "toxic"))
    assert chain.models[1].numFeatures == chain.models[0].numFeatures + 1
    got = {x.doc_id: x.flagged for x in toxicity.score_chain(every, chain).collect()}
    assert sum(got[i] == bool(t) for i, _, t in labels[400:]) >= 195
    assert toxicity.score_chain(docs, chain).count() == len(rows()) and toxicity.score_chain(none, chain).count() == 0
    assert toxicity.score_chain(docs, toxicity.train_chain(none, marked, ("poor", "toxic"))).where("flagged or p_toxic > 0").count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 4, 6])
def test_toxicity_of_few_labels(spark, n):
    """Too few texts to share a word give the rates, and nothing crashes, with one class or two."""
    docs = spark.createDataFrame([(i, words(i, 8, 30)) for i in range(6)] + [(9, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 1) for i in range(n)], "doc_id long, poor int, toxic int")
    got = toxicity.score_chain(docs, toxicity.train_chain(docs, labels, ("poor", "toxic"))).collect()
    assert len(got) == 7 and all(0 <= p <= 1 for r in got for p in (r.p_poor, r.p_toxic))
    if n < 5:
        assert {round(r.p_poor, 9) for r in got} == {round((n // 2) / n, 9)} and all(r.p_toxic == 1 and r.flagged for r in got)
    one = toxicity.ChainSettings(folds=1, min_documents=1)
    assert toxicity.score_chain(docs, toxicity.train_chain(docs, labels, ("poor", "toxic"), settings=one)).count() == 7


def test_chain_is_brute_force(spark):
    """The same chain in plain numpy: every model at its optimum, out-of-fold probabilities passed on."""
    r = random.Random(8)
    texts = [" ".join(r.choices(["calm", "rude", "spam", "news", "vile", "tree"], k=4)) for _ in range(150)]
    out = [(i, t, int(("spam" in t) != (r.random() < 0.2)), int(("vile" in t and "spam" in t) != (r.random() < 0.15))) for i, t in enumerate(texts)]
    df = spark.createDataFrame(out, "doc_id long, text string, poor int, toxic int")
    settings = toxicity.ChainSettings(ridge=0.01, iterations=200)
    chain = toxicity.train_chain(df, df, ("poor", "toxic"), settings=settings)
    got = {x.doc_id: (x.p_poor, x.p_toxic) for x in toxicity.score_chain(df, chain).collect()}
    fold = {x.doc_id: x.f for x in df.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3)).alias("f")).collect()}
    x, poor, toxic = np.array([[float(w in t.split()) for w in chain.words.vocabulary] for t in texts]), *np.array([o[2:] for o in out], float).T
    folds = np.array([fold[i] for i in range(150)])
    first = brute.logistic(x, poor, 0.01)
    passed = np.empty(150)
    for k in range(3):
        passed[folds == k] = brute.logistic(x[folds != k], poor[folds != k], 0.01)(x[folds == k])
    second = brute.logistic(np.column_stack([x, passed]), toxic, 0.01)
    want = np.column_stack([first(x), second(np.column_stack([x, first(x)]))])
    assert np.abs(np.array([got[i] for i in range(150)]) - want).max() < 2e-3


def test_language_is_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.substring("text", 1, 400).alias("text"), "lang").limit(80)
    extra = spark.createDataFrame([(10**6, chr(0x30000) * 5, "zz"), (10**6 + 1, "1 2 !", "en"), (10**6 + 2, None, "en")], docs.schema)
    docs = docs.unionByName(extra)
    rows = docs.collect()
    want = brute.languages([(r.doc_id, r.text, r.lang) for r in rows])
    got = {r.doc_id: r for r in language_id.predict(docs, language_id.train(docs)).collect()}
    for k, (lang, p) in want.items():
        assert got[k].lang_pred == lang and abs(got[k].score - p) < 1e-3
    assert got[10**6].lang_pred == "zz" and got[10**6 + 1].lang_pred == "und"


def test_preferences(spark):
    turns = "pair_id long, turn long, role string, text string, side string"
    long_text = words(1, 50_000)
    chosen = [(1, 0, "system", "s"), (1, 1, "user", "q"), (1, 2, "assistant", "good"), (2, 0, "user", "a"), (3, 0, "user", None), (None, 0, "user", "n"),
              (4, 0, "user", "x"), (4, 1, "assistant", "y"), (4, 1, "assistant", "y"), (5, None, "user", "first"), (5, 0, "assistant", long_text)]
    rejected = [(1, 0, "system", "s"), (1, 1, "user", "q"), (1, 2, "assistant", "bad"), (1, 3, "user", "more"), (2, 0, "user", "a"), (3, 0, "user", ""),
                (4, 0, "user", "x"), (5, None, "user", "first"), (5, 0, "assistant", long_text + " more")]
    got = preference.format_preferences(*(spark.createDataFrame([(*r, "clash") for r in side], turns) for side in (chosen, rejected))).collect()
    at = {(r.pair_id, r.side, r.turn): r for r in got}
    assert at[1, "prompt", 0].rendered == "<|system|>\ns\n" and not at[1, "prompt", 1].in_loss
    assert at[1, "chosen", 2].in_loss and at[1, "rejected", 2].in_loss and not at[1, "rejected", 3].in_loss
    assert at[2, "prompt", 0].tie and not at[1, "prompt", 0].tie
    assert (3, "chosen", 0) in at and (3, "rejected", 0) in at and (None, "chosen", 0) in at
    assert sum((r.pair_id, r.side, r.turn) == (4, "chosen", 1) for r in got) == 2 and (4, "rejected", 1) not in at
    assert at[5, "prompt", None].rendered == "<|user|>\nfirst\n" and len(at[5, "rejected", 0].rendered) == len(at[5, "chosen", 0].rendered) + 5
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string, extra int")
    assert preference.format_preferences(*preference.reply_pairs(empty)).count() == 0


def test_parts_in_any_order(spark):
    """Rows of one turn are compared as a whole; one row more on a side is a difference."""
    turns = "pair_id long, turn long, role string, text string"
    one, two = [(1, 0, "user", "a"), (1, 0, "user", "b"), (2, 0, "user", "a")], [(1, 0, "user", "b"), (1, 0, "user", "a"), (2, 0, "user", "a"), (2, 0, "user", "a")]
    got = preference.format_preferences(spark.createDataFrame(one, turns), spark.createDataFrame(two, turns)).collect()
    assert sorted((r.pair_id, r.side) for r in got) == [(1, "prompt"), (1, "prompt"), (2, "chosen"), (2, "rejected"), (2, "rejected")]


def test_every_turn_comes_out(spark):
    """Every row is on the chosen side; turns after the reply that differs are on both sides."""
    rows = [(4, 0, "user", "q"), (4, 1, "assistant", "a"), (4, 2, "user", "thanks"), (5, 0, "user", "q"), (5, 1, "assistant", "b"), (8, 0, "user", "alone")]
    rows += [(c, t, role, f"{role} {t} {c if t == 1 else ''}") for c in (2, 3) for t, role in enumerate(["user", "assistant"] * 3)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = preference.format_preferences(*preference.reply_pairs(df)).collect()
    assert sorted((r.pair_id, r.turn) for r in got if r.side != "rejected") == sorted((c, t) for c, t, _, _ in rows)
    assert {(r.side, r.rendered, r.in_loss) for r in got if r.pair_id == 4 and r.turn == 2} == {(s, "<|user|>\nthanks\n", False) for s in ("chosen", "rejected")}
    # Of numbers with the second bit the first reply differs, and so the prompt ends before it.
    assert {r.turn for r in got if r.pair_id == 2 and r.side == "prompt"} == {0}
    assert sorted((r.side, r.turn) for r in got if r.pair_id == 2 and r.in_loss) == [(s, t) for s in ("chosen", "rejected") for t in (1, 3, 5)]


def test_urls(spark):
    rules = spark.createDataFrame([("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"),
                                   ("EXAMPLE.org", "/a", "block"), ("example.org", "/a", "allow"), (None, None, None)], "host string, path string, action string")
    urls = [("http://WWW.Example.com/en/1?x=/en/", "www.example.com/en/", "allow"), ("http://blog.example.com/en/", "example.com/en/", "block"),
            ("http://notexample.com/en/", "com/", "allow"), ("http://x.net/es/1", "net/es/", "block"), ("http://x.net/es", None, "allow"),
            ("http://a.com", None, "allow"), ("http://a.com#/en/", None, "allow"), ("https://example.org/a", "example.org/a", "block"),
            (None, None, "allow"), ("no scheme.com/", None, "allow"), ("", None, "allow"), ("x://" + "a." * 3000 + "com/" + "b/" * 3000, "com/", "allow")]
    pages = spark.createDataFrame([(i, u, "clash") for i, (u, _, _) in enumerate(urls)] + [(0, urls[0][0], "clash"), (None, None, "clash")], "page_id long, url string, rule string")
    got = url_filter.judge_urls(pages, rules).collect()
    assert len(got) == len(urls) + 2 and sum(r.page_id == 0 for r in got) == 2
    for r in got:
        if r.page_id is not None:
            assert (r.rule, r.verdict) == urls[r.page_id][1:]
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0
    assert url_filter.judge_urls(pages, rules.limit(0)).where("verdict = 'allow' and rule is null").count() == len(got)


def test_url_paths_without_a_slash(spark):
    """A rule path that ends inside a name fits every path that starts with it."""
    rules = spark.createDataFrame([("example.org", "/a", "block"), ("example.org", "/ab/ç", "allow"), ("x.org", "/long/path", "block")], "host string, path string, action string")
    urls = {"http://example.org/a": "/a", "http://example.org/a/b": "/a", "http://example.org/abc?q": "/a", "http://www.example.org/ab/çd/e": "/ab/ç",
            "http://example.org/ab/": "/a", "http://example.org/b/a": None, "http://example.org/": None, "http://x.org/long/pat": None, "http://x.org/long/paths/1": "/long/path"}
    got = url_filter.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()
    assert len(got) == len(urls)
    for r in got:
        path = urls[r.url]
        assert r.rule == (path and ("x.org" if "//x.org" in r.url else "example.org") + path)
        assert r.verdict == ("block" if path in ("/a", "/long/path") else "allow")


def test_apply_times(spark, docs):
    keys = docs.select(F.col("doc_id").alias("_key"), *shared.fingerprint("text"))
    twice = keys.withColumn("times", F.when(F.col("_key").isin(3, 5), 2).when(F.col("_key") == 4, 0).otherwise(1))
    got = shared.apply_times(docs, twice)
    count = {r.doc_id: r.n for r in got.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert got.columns == docs.columns and count[3] == 2 and count[5] == 4 and 4 not in count and count[6] == 2 and count[None] == 2


def test_work_is_cleared(spark, docs, tmp_path):
    """Intermediate tables go when asked; what was written elsewhere stays."""
    from pathlib import Path

    shared.clear_work(spark)
    exact_dedup.exact_groups(docs).write.parquet(str(tmp_path / "kept"))
    made = [Path(f.removeprefix("file:")) for f in shared._MADE[spark.sparkContext.applicationId]]
    assert made and all(f.exists() for f in made)
    assert shared.clear_work(spark) == len(made) and not any(f.exists() for f in made)
    assert shared.clear_work(spark) == 0 and spark.read.parquet(str(tmp_path / "kept")).count() == len(rows())


def test_quality_stage_without_a_length(spark, docs):
    assert corpus_pipeline.quality_rules(spark, docs.drop("n_chars"), "").columns == [c for c in docs.columns if c != "n_chars"]


def test_stages_keep_columns(spark, docs, tmp_path):
    current = docs.where("doc_id is not null")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, current, "").write.parquet(str(tmp_path / name))
        current = spark.read.parquet(str(tmp_path / name))
        if i < 4:
            assert current.columns == docs.columns
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs.limit(0), "").count()


def test_forest_rows_are_not_written(spark, monkeypatch):
    """Rows of all sets and trees stay out of the work folder, and orders leave out what names their region."""
    written, stash = {}, near_dedup.stash
    monkeypatch.setattr(near_dedup, "stash", lambda df, name: written.update({name: stash(df, name)}) or written[name])
    docs = spark.createDataFrame([(i, words(40 + i // 2, 60) + (" x" if i % 2 else "")) for i in range(20)], "doc_id long, text string")
    forest = near_dedup.Forest(words=2)
    assert near_dedup.near_groups(docs, forest=forest).where("kept").count() == 10
    assert "near_forest" not in written
    shared_rows = written["forest_shared"]
    assert 0 < shared_rows.count() < 20 * forest.trees
    assert {r[0] for r in shared_rows.select(F.length("order_key")).distinct().collect()} == {4 * (forest.deepest - forest.depth)}


def test_fits_have_few_tasks(spark, monkeypatch):
    """The tasks of a step of a fit follow the bounded number of labelled rows, not the partitions of the documents."""
    tasks, fit = [], toxicity.LogisticRegression.fit
    monkeypatch.setattr(toxicity.LogisticRegression, "fit", lambda self, rows: tasks.append(rows.rdd.getNumPartitions()) or fit(self, rows))
    docs = spark.createDataFrame([(i, "bad words here" if i % 2 else "good words there") for i in range(120)], "doc_id long, text string").repartition(60)
    labels = docs.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("poor"), (F.col("doc_id") % 2).alias("toxic"))
    chain = toxicity.train_chain(docs, labels, ("poor", "toxic"), settings=toxicity.ChainSettings(max_labelled=200, iterations=3))
    assert tasks and max(tasks) == 1
    assert toxicity.score_chain(docs, chain).where("flagged").count() == 60
