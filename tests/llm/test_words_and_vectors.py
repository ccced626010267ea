"""Spelling variants, hard negatives and sentence pieces against plain versions, with their edge cases."""

import hashlib
import random
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from jobweave.llm import hard_negatives, queries, sentence_pieces, spelling
from jobweave.llm.memory import WordMemory

TEXTS = [None, "", " ", "Colour colour COLOUR", "▁x ▁", "a\u0000b\r\n\t", "é é ÉCOLE", " " * 3_000 + "x", "ab" * 3_000, "a " * 20_000, "<s>hi</s> <0x41>", "😀‍"]


# --- spelling ---------------------------------------------------------------------------

def one_edit(u, v):
    if u == v or abs(len(u) - len(v)) > 1:
        return False
    u, v = sorted((u, v), key=len)
    at = next((i for i, (a, b) in enumerate(zip(u, v)) if a != b), len(u))
    return u[at + (len(u) == len(v)):] == v[at + 1:]


def brute_forms(counts):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * n else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, n, len(near[w]), form[w], counts.get(form[w]), root(w)) for w, n in counts.items()}


@pytest.mark.parametrize("cell_words", [1, 3, 20_000])
def test_forms_are_brute_force(spark, cell_words):
    """Words of few letters, so that many are near; small cells are halved down to one place."""
    r = random.Random(5)
    words = {"".join(r.choice("abé") for _ in range(r.randrange(5, 9))) for _ in range(250)}
    words |= {"x" * 2_000, "x" * 2_001, "x" * 1_000 + "y" + "x" * 999, "same" * 400, "same" * 399 + "sane"}
    counts = {w: r.choice([3, 3, 4, 7, 15, 40]) for w in words}
    rows = spark.createDataFrame([*counts.items(), ("abcd", 9), ("abcdef", 2), (None, 5)], "word string, n long")
    got = spelling.forms(rows, cell_words=cell_words).select("word", "n", "n_near", "form", "form_n", "root").collect()
    assert {tuple(x) for x in got} == brute_forms(counts) and len(got) == len(counts)


def test_acceptor_shares_endings():
    words = sorted(a + b for a in ("colo", "hono", "labo") for b in ("r", "red", "ring", "rs"))
    acceptor = spelling.Acceptor(words)
    assert len(acceptor.arcs) < 1 + sum(len(set(w[:i] for w in words)) for i in range(1, 8))
    pairs = {(words[i], words[j]) for i, j in acceptor.pairs(at_end=True)}
    want = {(u, v) for u, v in combinations(words, 2) if one_edit(u, v)}
    assert {tuple(sorted(p)) for p in pairs} == {tuple(sorted(p)) for p in want}


def test_word_counts(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS * 30)] + [(None, "Keyless Keyless")], "doc_id long, text string")
    want = Counter()
    for key, text in [(i, t) for i, t in enumerate(TEXTS * 30)] + [("", "Keyless Keyless")]:
        run = ""
        for c in (text or "") + " ":
            if "a" <= c <= "z" or "A" <= c <= "Z" or "À" <= c <= "ÿ":
                run += c.lower() if c.isascii() else c
            elif run:
                h = zlib.crc32(f"{key}:{run}".encode())
                at = h % len(run)
                want[run[:at] + run[at + 1:] if h % 7 == 0 else run] += 1
                run = ""
    got = {r.word: r.n for r in spelling.word_counts(docs, drop_one_in=7).collect()}
    assert got == want
    assert spelling.forms(spelling.word_counts(docs.limit(0))).count() == 0
    with pytest.raises(ValueError):
        spelling.forms(docs.selectExpr("text AS word", "doc_id AS n"), times=1)


# --- hard negatives -----------------------------------------------------------------------

def brute_negatives(rows, window):
    whole = {(i, lab, tuple(int(np.floor(256.0 * x)) for x in v)) for i, v, lab in rows
             if None not in (i, v, lab) and all(x is not None and np.isfinite(x) for x in v)}
    whole = {r for r in whole if sum(x * x for x in r[2]) <= hard_negatives.LARGEST_NORM}
    out = []
    for a in whole:
        if a[0] % 50:
            continue
        scored = [(-sum(x * y for x, y in zip(a[2], b[2])), b[0], b[1]) for b in whole if len(a[2]) == len(b[2]) and a[0] != b[0]]
        scored.sort(key=lambda s: s[:2])
        for p, i, _ in [s for s in scored if s[2] == a[1]][:window.positives]:
            fits = [s for s in scored if s[2] != a[1] and window.low * -p <= -100 * s[0] <= window.high * -p]
            out += [(a[0], i, k, s[1], -p, -s[0]) for k, s in enumerate(fits[:window.negatives], 1)]
    return sorted(out)


def vectors():
    r = np.random.default_rng(3)
    rows = [(i, [float(x) for x in r.normal(0, 0.4, 8).astype(np.float32)], int(r.integers(3))) for i in range(400)]
    same = rows[50][1]
    rows += [(1_000 + i, same, i % 3) for i in range(60)]  # ties
    rows += [rows[0], rows[3], (2_000, None, 1), (2_050, same, None), (None, same, 1), (2_100, [0.5, None, *same[2:]], 1), (2_150, [float("nan"), *same[1:]], 1)]
    rows += [(2_200, [float("inf"), *same[1:]], 1), (2_250, [1e30, *same[1:]], 1), (2_300, [], 1), (2_301, [], 1), (2_302, [], 2)]
    rows += [(3_000 + i, [float(i % 5), -3.0], i % 2) for i in range(60)]
    return rows


@pytest.mark.parametrize("scores_at_once", [64, 1 << 21])
def test_negatives_are_brute_force(spark, monkeypatch, scores_at_once):
    monkeypatch.setattr(hard_negatives, "BLOCK_NUMBERS", 256 * 8)
    monkeypatch.setattr(hard_negatives, "SCORES_AT_ONCE", scores_at_once)
    window = hard_negatives.Window(positives=4, negatives=3)
    df = spark.createDataFrame(vectors(), "vec_id long, embedding array<double>, label int")
    extra = df.withColumns({"row": F.lit("r"), "dims": F.lit("d"), "score": F.lit(0), "id": F.lit("i")})
    got = hard_negatives.mine(extra, F.col("id") % 50 == 0, "vec_id", "embedding", "label", window).collect()
    assert sorted(tuple(r) for r in got) == brute_negatives(vectors(), window) and got
    assert hard_negatives.mine(df.limit(0), F.col("id") % 50 == 0, "vec_id", "embedding", "label").count() == 0


@pytest.mark.parametrize("size, dims", [(3, 5), (127, 64), (40_000, 2_500), (1 << 27, 4)])
def test_residues_are_exact(size, dims):
    r = np.random.default_rng(size)
    a, b = (r.integers(-size, size + 1, (n, dims)) for n in (7, 11))
    a[0], b[0], b[1] = size, size, -size
    primes = hard_negatives.primes_for(int(size * size * dims))
    left, right = hard_negatives.Residues(a, primes), hard_negatives.Residues(b, primes)
    want = np.array([[sum(int(x) * int(y) for x, y in zip(u, v)) for v in b] for u in a])
    assert (hard_negatives.exact_scores(left, right, slice(0, 7), primes) == want).all()


# --- sentence pieces --------------------------------------------------------------------------

@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=queries.PIECE_MODEL)


def check_pieces(library, encoder, texts):
    ids, lengths = encoder.encode(pa.array([t or "" for t in texts], pa.string()))
    decoded = encoder.model.decode_flat(ids, lengths)
    edges = np.concatenate([[0], np.cumsum(lengths)])
    for k, text in enumerate(texts):
        want = library.encode(text or "", add_eos=True)
        assert ids[edges[k]:edges[k + 1]].tolist() == want, repr(text)[:100]
        assert decoded[k] == library.decode(want)


@pytest.mark.parametrize("pool", [
    list("ab "), list("abcdefgh  \n"), [chr(i) for i in range(32, 127)], list(" ▁\r\n\t;){}"), [chr(i) for i in range(32, 0x3000)],
    ["the", "ing", " ", "  ", "tion", "Inter", "nation", "al", "ab", "ba", " s"],
])
def test_pieces_are_the_library(library, pool):
    r = random.Random(len(pool))
    encoder = sentence_pieces.PieceEncoder(queries.PIECE_MODEL)
    check_pieces(library, encoder, TEXTS)
    check_pieces(library, encoder, ["".join(r.choice(pool) for _ in range(r.randrange(100))) for _ in range(1_500)])


def test_long_runs_merge_alike(library, monkeypatch):
    """The heap for very long runs and the rounds give the same."""
    r = random.Random(2)
    texts = ["".join(r.choice("aeinrst") for _ in range(700)) for _ in range(20)] + [" " * 200 + "a" * 300]
    for most in (10, 1_000_000):
        monkeypatch.setattr(sentence_pieces, "LONG_RUN", most)
        check_pieces(library, sentence_pieces.PieceEncoder(queries.PIECE_MODEL), texts)


def test_any_ids_decode(library):
    r = random.Random(4)
    model = sentence_pieces.PieceEncoder(queries.PIECE_MODEL).model
    lists = [[r.choice([0, 1, 2, 259, 28705, r.randrange(32_000), r.randrange(3, 259)]) for _ in range(r.randrange(7))] for _ in range(4_000)]
    got = model.decode_flat(np.array([i for x in lists for i in x]), np.array(list(map(len, lists))))
    assert got == [library.decode(x) for x in lists]


def test_memory_forgets_and_learns_again():
    calls = []

    def encode(words):
        calls.append(words.to_pylist())
        return np.array([len(w) for w in words.to_pylist()], np.int32), np.ones(len(words), np.int64)

    memory = WordMemory(encode, most=3, longest=4)
    for words in (["a", "bb", "a"], ["ccc", "a", "too long"], ["a", "dddd", "bb"], ["e", "a"], [], ["a", None]):
        words = [w or "" for w in words]
        ids, lengths = memory.ids_of(pa.array(words, pa.string()))
        assert ids.tolist() == [len(w) for w in words] and lengths.tolist() == [1] * len(words)
        assert len(memory.words) <= 3
    assert calls[1] == ["ccc", "too long"]


def test_op13_is_the_library(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op13_sentence_pieces(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode(d.text or "", add_eos=True)
        digests = (hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), library.decode(ids)))
        assert got[d.doc_id] == (len(ids), *digests)


def test_pieces_of_odd_tables(spark):
    rows = [(None if i == 2 else i // 2, t, "i", "k") for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _ids string, _key string")
    got = sentence_pieces.encode_decode(docs, queries.PIECE_MODEL, beside=["_ids", "_key"]).collect()
    assert len(got) == len(rows) and all((r["_ids"], r["_key"]) == ("i", "k") for r in got)
    assert sentence_pieces.encode_decode(docs.limit(0), queries.PIECE_MODEL).count() == 0
