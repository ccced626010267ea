"""Each dealt query over its whole table: against its SQL twin, or against brute force."""

import hashlib
import zlib

import pytest
from brute import components, decisions, quality, word_library
from comparing import compare, duck

import __spark_entry__ as entry_points
import corpus_pipeline
from jobweave.llm import queries, shared

NAMES = sorted(queries.QUERIES)


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.fixture(scope="module")
def documents(con):
    return con.execute("SELECT doc_id, text, lang, source, n_chars FROM documents ORDER BY doc_id").fetchall()


def test_registered():
    assert set(NAMES) | {"pipeline"} <= set(entry_points.queries())
    assert {n.split("_")[0] for n in NAMES} == {f"op{i}" for i in range(1, 14)}


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, sf_dir, con, name):
    assert compare(queries.QUERIES[name](spark, sf_dir), con, queries.SQL[name]) is None


def test_op10_takes_lines_out(spark):
    """On the given table of 10,000 documents lines go, and documents that are depleted without them."""
    sf_dir = "/root/testdata/sf0.1"
    docs = duck(sf_dir).execute("SELECT doc_id, text, lang, source, n_chars FROM documents").fetchall()
    rows = queries.op10_quality(spark, sf_dir).collect()
    want = quality(docs)
    assert {r.doc_id for r in rows if r.kept} == {d[0] for d in want}
    assert any(r.n_words_left < r.n_words for r in rows) and any(not r.kept and not r.base_failed for r in rows)
    # The same holds for the pipeline's stage: its texts are those without the lines.
    texts = {d[0]: d[1] for d in docs}
    stage = corpus_pipeline.quality_rules(spark, shared.table(spark, sf_dir, "documents"), sf_dir).select("doc_id", "text", "n_chars").collect()
    assert sorted(map(tuple, stage)) == sorted((d[0], d[1], d[4]) for d in want) and any(r.text != texts[r.doc_id] for r in stage)


def test_op6_prefix_search_decides(spark, sf_dir):
    """Some prompts end before the last reply, and both sides come whole."""
    rows = queries.op6_preference(spark, sf_dir).collect()
    given = shared.table(spark, sf_dir, "conversations").collect()
    assert sorted((r.pair_id, r.turn) for r in rows if r.side != "rejected") == sorted((r.conv_id, r.turn) for r in given)
    chosen = [r for r in rows if r.side == "chosen" and r.in_loss]
    assert max(sum(c.pair_id == p for c in chosen) for p in {c.pair_id for c in chosen}) > 1


def test_op3_is_the_library(spark, sf_dir, documents):
    library = word_library()
    got = {r.doc_id: r for r in queries.op3_bpe(spark, sf_dir).collect()}
    assert len(got) == len(documents)
    for doc_id, text, *_ in documents:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert got[doc_id].n_tokens == len(ids)
        assert got[doc_id].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[doc_id].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_op4_is_brute_force(spark, sf_dir, documents):
    want = components([(d[0], d[1]) for d in documents], 2)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in queries.op4_near_dedup(spark, sf_dir).collect()}
    assert got == {k: (n, c, k == c) for k, (n, c) in want.items()}


def test_op5_learns_the_language(spark, sf_dir, documents):
    rows = {r.doc_id: r for r in queries.op5_language_id(spark, sf_dir).collect()}
    assert len(rows) == len(documents)
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 4 == 2) and 0 <= r.score <= 1 for k, r in rows.items())
    held = [(rows[d[0]].lang_pred, d[2]) for d in documents if rows[d[0]].held_out and d[2]]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)


def test_op7_is_the_library(spark, sf_dir, documents):
    library, start = word_library(), 0
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op7_token_files(spark, sf_dir).collect()}
    for doc_id, text, *_ in documents:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        assert got.pop(doc_id) == (start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids)))
        start += len(ids)
    assert not got


def test_op1_scores_every_document(spark, sf_dir, documents):
    rows = queries.op1_toxicity(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == [d[0] for d in documents]
    assert all(0 <= p <= 1 for r in rows for p in (r.p_poor, r.p_toxic))


def test_pipeline_is_brute_force(spark, sf_dir, documents):
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in entry_points.queries()["pipeline"](spark, sf_dir).collect())
    assert got == sorted(decisions(documents))
