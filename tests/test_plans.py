"""Ingest, edits, index life and streams on real folders."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobweave import schema
from jobweave.plans import changes
from jobweave.plans.enrich import enrich_backfill
from jobweave.plans.ingest import PostingStore, ingest_batch
from jobweave.plans.resume import analyze_resumes
from jobweave.plans.search_index import IndexNotUsable, IndexStore, active_run
from jobweave.sources.board_feed import parse_feed
from jobweave.sources.tables import BatchTable, BucketTable
from jobweave.streaming.ingest_stream import read_feed_stream, stream_ingest
from jobweave.streaming.metrics_stream import append_log, stream_log


def offer(i, title=None, text="", skills=("Python",)):
    return json.dumps({
        "url": f"o{i}", "title": f"Dev {i % 3}" if title is None else title, "name": "Acme", "category": "backend", "posted": 1704067200000, "description": text,
        "salary": {"from": 100, "to": 150, "currency": "PLN", "type": "b2b"},
        "tiles": {"values": [{"type": "requirement", "value": s} for s in skills]},
    })


def write_lines(path, name, lines):
    (path / name).write_text("\n".join(lines) + "\n")


BATCHES = [
    [offer(1, text="knows docker, SQL"), offer(2), offer(1, title="again")],
    [offer(1), offer(3, skills=("Docker", "SQL")), offer(4, title=""), "{broken"],
    [offer(5, title="DEV 2", text="python"), offer(2)],
]


def now(batch):
    return f"2024-07-0{batch + 1} 10:00:00"


def state(store):
    p = {r.url.rsplit("/", 1)[-1]: (r.title, r.is_reposted, r.original_job_id, r.salary_period, r.salary_max_pln, r.date_added) for r in store.postings.read().collect()}
    d = {(r.job_id, r.skill_name, r.source_field) for r in store.detected.read().collect()}
    a = {(r.batch, r.imported, r.skipped, r.errors, r.processed) for r in store.audit.read().collect()}
    return p, d, a


def test_ingest_batches_and_stream_agree(spark, tmp_path):
    by_hand = PostingStore.at(spark, str(tmp_path / "hand"))
    inbox = tmp_path / "in"
    inbox.mkdir()
    streamed = PostingStore.at(spark, str(tmp_path / "stream"))
    for b, lines in enumerate(BATCHES):
        good, bad = parse_feed(spark.createDataFrame([(x, i) for i, x in enumerate(lines)], "line string, position int"))
        rejected = bad.select(F.lit(None).cast("string").alias("url"), F.lit("nofluffjobs.com").alias("source"), "error")
        for _ in range(2 if b == 1 else 1):  # a repeated batch adds nothing
            ingest_batch(by_hand, good, b, now(b), None, rejected)
        write_lines(inbox, f"{b}.json", lines)
        query = stream_ingest(read_feed_stream(spark, str(inbox)), streamed, str(tmp_path / "checkpoint"), now)
        query.awaitTermination()
    p, d, a = state(by_hand)
    assert (p, d, a) == state(streamed)
    assert set(p) == {"o1", "o2", "o3", "o5"}
    assert p["o1"][:2] == ("Dev 1", False) and p["o5"][1] and p["o2"][3:] == ("hourly", 24000.0, "2024-07-01")
    assert a == {(0, 2, 0, 0, 2), (1, 1, 1, 2, 4), (2, 1, 1, 0, 2)}
    assert all(s == "Python" and f == "description" for _, s, f in d)


def test_batch_table(spark, tmp_path):
    t = BatchTable(spark, str(tmp_path / "t"), schema.DETECTED)
    rows = [spark.createDataFrame([(str(i), "a", "title")], schema.DETECTED) for i in range(4)]
    assert t.read().count() == 0 and not t.has_batch("x", 0)
    t.append(rows[0], 0, "x")
    t.append(rows[1], 0, "x")  # a repeated batch adds nothing
    t.append(rows[2], 1, "x")
    t.append(rows[3], 1, "y/z w")
    assert sorted(r.job_id for r in t.read().collect()) == ["0", "2", "3"]
    assert [r.job_id for r in t.read_batch("y/z w", 1).collect()] == ["3"]
    (tmp_path / "t" / "feed=f-x" / "batch=1" / "_SUCCESS").unlink()  # as if the write had been cut short
    t.append(rows[1], 1, "x")
    assert sorted(r.job_id for r in t.read().collect()) == ["0", "1", "3"]


def test_edits_rewrite_touched_buckets_only(spark, tmp_path):
    """Files of buckets without an edit stay, by name and time."""
    def files():
        return {str(p): p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("*.parquet")}

    t = BucketTable(spark, str(tmp_path / "t"), "id", buckets=16)
    t.create(rows_for_index(spark, 200).withColumns({"salary_min": F.lit(9000.0), "salary_currency": F.lit("PLN")}))
    before = files()
    edits = spark.createDataFrame([("3", "applied"), ("17", "seen")], "id string, status string")
    touched = t.edit(edits, lambda rows, some: changes.apply_changes(rows, some, "2024-07-01"))
    after = files()
    of = lambda names, k: {n for n in names if f"_bucket={k}/" in n}
    assert 1 <= len(touched) <= 2 and len({n.split("_bucket=")[1].split("/")[0] for n in before}) > 10
    assert {n: s for n, s in before.items() if not any(n in of(before, k) for k in touched)} == {n: s for n, s in after.items() if not any(n in of(after, k) for k in touched)}
    got = {r.id: (r.status, r.applied_date) for r in t.read().collect()}
    assert len(got) == 200 and got["3"] == ("applied", "2024-07-01") and got["17"][0] == "seen" and got["4"][0] is None
    paid = t.edit(edits, lambda rows, _: changes.backfill_salaries(rows).drop("updated"))
    assert paid == touched and t.read().where("salary_min_pln is not null").count() == t.read().where(t.bucket_of(F.col("id")).isin(touched)).count()
    assert t.edit(edits.limit(0), lambda rows, some: rows) == []


def test_edits_and_crawls_repeat(spark):
    from jobweave.plans.changes import apply_changes, merge_enrichment

    stored = schema.conform(rows_for_index(spark, 2).withColumn("description", F.lit("")), schema.POSTING)
    edits = spark.createDataFrame([("0", "seen", None, 1), ("0", "applied", None, 2), ("0", None, "n", 3)], "id string, status string, notes string, at int")
    got = {r.id: (r.status, r.notes, r.applied_date) for r in apply_changes(stored, edits, "2024-05-05", at="at").collect()}
    assert len(got) == 2 and got["0"] == ("applied", "n", "2024-05-05")
    pages = spark.createDataFrame([("u0", "long text", ["A"], None, 1), ("u0", "new", ["B"], None, 2), ("u1", "x", None, None, 1)],
                                  "url string, description string, skills_required array<string>, skills_nice_to_have array<string>, at int")
    got = sorted((r.url, r.description, r.skills_required) for r in merge_enrichment(stored, pages, at="at").collect())
    assert got == [("u0", "new", ["B"]), ("u1", "x", ["Python"])]


def rows_for_index(spark, n, start=0):
    rows = [(str(i), f"u{i}", f"Title {i}", "Acme", ["Python"], None, "text", dt.datetime(2024, 1, 1)) for i in range(start, start + n)]
    df = spark.createDataFrame(rows, "id string, url string, title string, company string, skills_required array<string>, skills_nice_to_have array<string>, description string, created_at timestamp")
    return schema.conform(df, schema.POSTING)


def test_index_life(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path))
    at = lambda d: dt.datetime(2024, 1, d)
    with pytest.raises(IndexNotUsable):
        store.build(rows_for_index(spark, 3), run_id="r0", now=at(1), mode="incremental", dims=8)
    assert store.build(rows_for_index(spark, 3), run_id="r1", now=at(2), dims=8)
    assert store.read_active().count() == 3
    failing = lambda texts: [None for _ in texts]
    assert not store.build(rows_for_index(spark, 5), run_id="r2", now=at(3), dims=8, embed_fn=failing)
    assert active_run(store.runs()).first().run_id == "r1" and store.read_active().count() == 3
    assert not store.build(rows_for_index(spark, 0), run_id="r3", now=at(4), dims=8)
    assert store.build(rows_for_index(spark, 5), run_id="r4", now=at(5), mode="incremental", dims=8)
    assert store.read_active().count() == 5 and active_run(store.runs()).first().run_id == "r4"
    with pytest.raises(IndexNotUsable):
        store.build(rows_for_index(spark, 6), run_id="r5", now=at(6), mode="incremental", dims=16)
    assert store.build(rows_for_index(spark, 2), run_id="r6", now=at(7), dims=16, embed_fn=lambda ts: [np.ones(16) for _ in ts])
    assert store.read_active().count() == 2


def test_edits(spark):
    rows = spark.createDataFrame([(1, "new", None, "n", False), (2, "seen", "2020-01-01", None, None)], "id long, status string, applied_date string, notes string, saved boolean")
    edits = spark.createDataFrame([(1, "applied", None, None, True), (2, None, None, "hello", None)], "id long, status string, applied_date string, notes string, saved boolean")
    got = {r.id: tuple(r)[1:] for r in changes.apply_changes(rows, edits, "2024-07-01").collect()}
    assert got == {1: ("applied", "2024-07-01", "n", True), 2: ("seen", "2020-01-01", "hello", None)}


def test_log_is_appended(spark, tmp_path):
    log = spark.createDataFrame([(dt.datetime(2024, 1, 1), "m", "chat", 5, 1, 2, 3)], schema.INFERENCE_LOG)
    append_log(log, str(tmp_path / "log"))
    append_log(log, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2
    stream = spark.readStream.schema(schema.INFERENCE_LOG).parquet(str(tmp_path / "log"))
    stream_log(stream, str(tmp_path / "copy"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "copy")).count() == 2


def small_postings(spark):
    rows = [
        (i, f"https://nofluffjobs.com/pl/job/{i}", "Dev", "Acme", "Backend", ["Python", "SQL"] if i % 2 else ["Go"], ["Docker"] if i < 4 else [], "has text" if i == 2 else None)
        for i in range(6)
    ] + [(9, "https://elsewhere.example/9", "Dev", "Acme", "Backend", [], [], None)]
    return spark.createDataFrame(rows, "id long, url string, title string, company string, category string, skills_required array<string>, skills_nice_to_have array<string>, description string")


def test_enrichment_run(spark):
    page = lambda i: (f"https://nofluffjobs.com/pl/job/{i}", "<h1>Dev</h1><h2>Opis</h2><p>We use Go and docker</p><h2>Required</h2><ul><li>SQL</li></ul>")
    done = enrich_backfill(small_postings(spark), spark.createDataFrame([page(0), page(1), page(2)], "url string, html string"))
    rows = {r.id: r for r in done.postings.collect()}
    assert {i for i, r in rows.items() if r.enriched} == {0, 1} and rows[1].skills_required == ["SQL"] and rows[2].description == "has text"
    assert {(r.job_id, r.skill_name) for r in done.detected.collect()} == {(0, "Go"), (1, "Go")}
    assert {r.url[-1] for r in done.errors.collect()} == {"3", "4", "5"}


def test_resume_analysis(spark):
    texts = spark.createDataFrame([(1, "Senior python / docker engineer"), (2, "gardener and cook")], "resume_id long, text string")
    out = analyze_resumes(texts, small_postings(spark))
    assert {(r.resume_id, r.skill) for r in out.skills.collect()} == {(1, "Python"), (1, "Docker"), (2, "gardener"), (2, "cook")}
    best = out.matches.where("resume_id = 1 AND rank = 1").first()
    assert (best.job_id, best.match_count, best.match_ratio) == (1, 2, 1.0)
    assert {r.resume_id: r.match_score for r in out.categories.collect()} == {1: 54}
    assert {(r.resume_id, r.category, r.skill) for r in out.to_add.collect()} == {(1, "Backend", "SQL"), (1, "Backend", "Go")}


def test_found_skills_are_stored_where_they_are_found(spark, tmp_path, monkeypatch):
    from jobweave.plans import ingest

    found, stored, detect = [], [], ingest.detect_skills
    monkeypatch.setattr(ingest, "detect_skills", lambda *a: found.append(detect(*a)) or found[-1])
    store = PostingStore.at(spark, str(tmp_path / "tables"))
    append = store.detected.append
    store.detected.append = lambda df, *a: (stored.append(df), append(df, *a))
    lines = spark.createDataFrame(list(enumerate(BATCHES[0] + [offer(6, text="python sql SQL", skills=("Docker", "SQL"))])), "position int, line string")
    ingest.ingest_batch(store, parse_feed(lines)[0], 0, now(0))
    assert stored[0] is found[0]
    pairs = [(r.job_id, r.skill_name) for r in store.detected.read().collect()]
    assert pairs and len(pairs) == len(set(pairs))


class OneMap:
    """State of a bucket, as a processor sees it."""

    def __init__(self):
        self.kept = {}

    def getMapState(self, name, key, value):
        return self

    def containsKey(self, key):
        return key in self.kept

    def getValue(self, key):
        return self.kept.get(key)

    def updateValue(self, key, value):
        self.kept[key] = value


def test_one_call_of_the_stream_has_many_urls_and_roles():
    import pandas as pd

    from jobweave.streaming.ingest_stream import _FirstOfRole, _FirstOfUrl

    def call(processor, columns, *parts):
        out = pd.concat(list(processor.handleInputRows((0,), iter([pd.DataFrame(p, columns=columns) for p in parts]), None)))
        return sorted(tuple(None if pd.isna(v) else v for v in r) for r in out.itertuples(index=False))

    urls, columns = _FirstOfUrl(), ["state_key", "place", "fate"]
    urls.init(OneMap())
    got = call(urls, columns, [("u", "2", "new"), ("v", "4", "new"), ("bad:1", "0", "error")], [("u", "1", "new"), ("bad:2", "5", "error")])
    assert got == [("bad:1", "0", "error"), ("bad:2", "5", "error"), ("u", "1", "new"), ("v", "4", "new")]
    assert call(urls, columns, [("w", "7", "new"), ("u", "6", "new")]) == [("u", "6", "known"), ("w", "7", "new")]
    assert call(urls, columns, [("bad:3", "8", "error")]) == [("bad:3", "8", "error")]

    roles, columns = _FirstOfRole(), ["role_key", "id", "has_role"]
    roles.init(OneMap())
    got = call(roles, columns, [("r", "b", True), ("s", "c", True)], [("r", "a", True), ("bad:1", "d", False)])
    assert got == [("bad:1", "d", False, False, None), ("r", "a", True, False, None), ("r", "b", True, False, None), ("s", "c", True, False, None)]
    got = call(roles, columns, [("r", "A", True), ("t", "e", True)], [("s", "f", True)])
    assert got == [("r", "A", True, True, "a"), ("s", "f", True, True, "c"), ("t", "e", True, False, None)]
    assert call(roles, columns, [("r", "g", True)]) == [("r", "g", True, True, "a")]


def test_an_enrichment_run_is_made_once(spark):
    """What a run yields is read from what it kept: postings are joined and pages parsed once, however often they are read."""
    stored = schema.conform(rows_for_index(spark, 3).withColumns({"url": F.concat(F.lit("https://nofluffjobs.com/pl/job/"), "id"), "description": F.lit("")}), schema.POSTING)
    html = "<h1>Dev</h1><p>Acme</p><h2>Opis</h2><p>Python and SQL</p>"
    done = enrich_backfill(stored, spark.createDataFrame([(f"https://nofluffjobs.com/pl/job/{i}", html) for i in range(2)], "url string, html string"))
    assert {(r.id, r.enriched, r.description) for r in done.postings.collect()} == {("0", True, "Python and SQL"), ("1", True, "Python and SQL"), ("2", False, "")}
    plan = done.postings._jdf.queryExecution().optimizedPlan().toString()
    assert "parquet" in plan and "Join" not in plan
    plan = done.detected._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "max_by" not in plan  # the spans with the dictionary
    assert [r.url[-1] for r in done.errors.collect()] == ["2"]


def test_a_batch_is_parsed_for_its_rows_and_its_rejects_only(spark, tmp_path):
    """Rejects are counted and stored from what was kept; a repetition of a complete batch parses nothing."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(title):
        made.add(1)
        return title

    rows = [(i, f"https://nofluffjobs.com/pl/job/{i}", title, "Acme") for i, title in enumerate(["Dev", "", "Go dev", "Dev"])]
    feed = spark.createDataFrame(rows, "position long, url string, title string, company string").withColumns({"title": counted("title"), "source": F.lit("b")})
    parsed = feed.select("position", "title", *[F.col(c) if c in feed.columns else F.lit(None).cast(schema.PARSED[c].dataType).alias(c) for c in schema.PARSED.names if c != "title"])
    store = PostingStore.at(spark, str(tmp_path))
    ingest_batch(store, parsed, 0, "2024-07-01 10:00:00")
    once = made.value
    assert store.postings.read().count() == 3 and [r.error for r in store.rejects.read().collect()] == ["missing title"]
    assert [(r.imported, r.errors) for r in store.audit.read().collect()] == [(3, 1)]
    ingest_batch(store, parsed, 0, "2024-07-01 10:00:00")
    assert made.value == once and store.postings.read().count() == 3


def test_state_passes_carry_no_columns_of_postings(spark, monkeypatch, tmp_path):
    from pyspark.sql.group import GroupedData

    from jobweave.streaming import ingest_stream

    seen, original = [], GroupedData.transformWithStateInPandas
    monkeypatch.setattr(GroupedData, "transformWithStateInPandas", lambda self, *a, **k: (seen.append(self._df.columns), original(self, *a, **k))[1])
    (tmp_path / "inbox").mkdir()
    rows = ingest_stream._fated(ingest_stream.read_feed_stream(spark, str(tmp_path / "inbox")), 4)
    assert len(seen) == 2 and all(len(columns) < 10 and "description" not in columns for columns in seen)
    assert {"description", "skills_required", "dropped_skills", "error", "fate", "is_reposted"} <= set(rows.columns)
