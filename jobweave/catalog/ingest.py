"""Batch ingest, edits, index bookkeeping."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from jobweave.catalog import query
from jobweave.catalog.views import DESCRIBED, LOG, PLAIN, with_salary
from jobweave.operators import dedup, listing
from jobweave.plans import changes, ingest, search_index
from jobweave.session import ensure_checkpoint_dir
from jobweave.sources import derived
from jobweave.streaming.metrics_stream import daily_metrics

# A feed that repeats every third posting later on, with another title.
_FEED = """, feed AS (SELECT id AS position, url, source, title, company, created_at FROM postings
 UNION ALL SELECT id + 100000000, url, source, title || ' again', company, created_at FROM postings WHERE id%3 = 0)"""


def _feed(p):
    cols = ["url", "source", "title", "company", "created_at"]
    again = p.where("id % 3 = 0").select((F.col("id") + 100000000).alias("position"), "url", "source", F.concat("title", F.lit(" again")).alias("title"), "company", "created_at")
    return p.select(F.col("id").alias("position"), *cols).unionByName(again)


@query("first_per_url", PLAIN + _FEED + " SELECT url, title, position FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY position) AS rn FROM feed) WHERE rn = 1")
def first_per_url(spark, sf):
    return ingest.first_per_url(_feed(derived.postings(spark, sf))).select("url", "title", "position")


@query("unseen_urls", PLAIN + _FEED + " SELECT url, position FROM feed WHERE url NOT IN (SELECT url FROM postings WHERE status = 'F')")
def unseen_urls(spark, sf):
    p = derived.postings(spark, sf)
    return ingest.unseen(_feed(p), p.where("status = 'F'")).select("url", "position")


_TAG = """, keyed AS (SELECT *, lower(title) AS tl, lower(company) AS cl FROM {0}), firsts AS (SELECT *, first_value(id) OVER w AS fid, first_value(batch_no) OVER w AS fb FROM keyed
 WINDOW w AS (PARTITION BY cl, tl ORDER BY batch_no, created_at NULLS LAST, id))"""


@query("tag_reposts", PLAIN + ", batched AS (SELECT *, id // 500 AS batch_no FROM postings)" + _TAG.format("batched") + """
 SELECT id, fb < batch_no AS is_reposted, CASE WHEN fb < batch_no THEN fid END AS original_job_id FROM firsts""")
def tag_reposts(spark, sf):
    batch = derived.postings(spark, sf).withColumn("batch_no", F.floor(F.col("id") / 500))
    return dedup.tag_reposts(batch).select("id", "is_reposted", "original_job_id")


@query("tag_reposts_against_stored", PLAIN + ", batched AS (SELECT *, CASE WHEN status = 'F' THEN -1 ELSE 0 END AS batch_no FROM postings)" + _TAG.format("batched") + """
 SELECT id, fb < batch_no AS is_reposted, CASE WHEN fb < batch_no THEN fid END AS original_job_id FROM firsts WHERE batch_no = 0""")
def tag_reposts_against_stored(spark, sf):
    p = derived.postings(spark, sf)
    batch = p.where("status <> 'F'").withColumn("batch_no", F.lit(0).cast("bigint"))
    return dedup.tag_reposts(batch, p.where("status = 'F'")).select("id", "is_reposted", "original_job_id")


_ID = "concat_ws('-', md5(url)[1:8], md5(url)[9:12], md5(url)[13:16], md5(url)[17:20], md5(url)[21:32])"


@query("insert_new_postings", with_salary(PLAIN) + f""", stored AS (SELECT {_ID} AS uid, * FROM paid WHERE status = 'F'), fresh AS (SELECT {_ID} AS uid, * FROM paid WHERE status <> 'F'),
 firsts AS (SELECT lower(title) AS tl, lower(company) AS cl, arg_min(uid, (created_at, uid)) AS original FROM stored GROUP BY 1, 2)
 SELECT uid AS id, url, original IS NOT NULL AS is_reposted, original AS original_job_id, salary_period, salary_min_pln, 'new' AS status, '2024-07-01' AS date_added, false AS saved
 FROM fresh LEFT JOIN firsts ON tl = lower(title) AND cl = lower(company)""")
def insert_new_postings(spark, sf):
    p = derived.postings(spark, sf)
    stored = p.where("status = 'F'").withColumn("id", ingest.posting_id())
    feed = p.drop("id", "is_reposted", "status", "saved", "date_added", "created_at").withColumn("batch_no", F.lit(0).cast("bigint"))
    new = ingest.new_postings(feed, stored, now="2024-07-01 10:00:00")
    return new.select("id", "url", "is_reposted", "original_job_id", "salary_period", "salary_min_pln", "status", "date_added", "saved")


@query("ingest_counts", PLAIN + """ SELECT source, CAST(count(*) FILTER (status = 'O') AS BIGINT) AS imported, CAST(count(*) FILTER (status = 'F') AS BIGINT) AS skipped,
 CAST(count(*) FILTER (status = 'P') AS BIGINT) AS errors, CAST(count(*) AS BIGINT) AS processed FROM postings GROUP BY source""")
def ingest_counts(spark, sf):
    p = derived.postings(spark, sf)
    return ingest.ingest_counts(p.where("status <> 'P'"), p.where("status = 'F'"), p.where("status = 'P'"))


@query("last_errors", PLAIN + """ SELECT source, url FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY created_at DESC, url) AS rn FROM postings WHERE status = 'P')""")
def last_errors(spark, sf):
    return ingest.last_errors(derived.postings(spark, sf).where("status = 'P'"), "created_at").select("source", "url")


@query("rejected_rows", PLAIN + """ SELECT id, CASE WHEN id%4 = 0 THEN 'missing title; missing company' ELSE 'missing company' END AS error FROM postings WHERE id%2 = 0""")
def rejected_rows(spark, sf):
    p = derived.postings(spark, sf)
    broken = p.withColumns({
        "title": F.when(F.col("id") % 4 == 0, "").otherwise(F.col("title")), "company": F.when(F.col("id") % 2 != 0, F.col("company")),
    })
    _, bad = ingest.valid_rows(broken)
    return bad.join(p.select("url", "id"), "url").select("id", "error")


# --- edits ----------------------------------------------------------------------------------

@query("apply_changes", PLAIN + """ SELECT id, CASE WHEN id%5 = 0 THEN 'applied' WHEN id%5 = 1 THEN 'offer' ELSE status END AS status,
 CASE WHEN id%10 = 0 THEN '2024-01-02' WHEN id%5 = 0 THEN '2024-07-01' END AS applied_date, CASE WHEN id%5 = 1 THEN true ELSE saved END AS saved FROM postings""")
def apply_changes(spark, sf):
    p = derived.postings(spark, sf).withColumn("applied_date", F.lit(None).cast("string"))
    k = F.col("id") % 5
    edits = p.where(k < 2).select(
        "id", F.when(k == 0, "applied").otherwise("offer").alias("status"), F.when(F.col("id") % 10 == 0, "2024-01-02").alias("applied_date"),
        F.when(k == 1, True).alias("saved"),
    )
    return changes.apply_changes(p, edits, "2024-07-01").select("id", "status", "applied_date", "saved")


@query("delete_postings", PLAIN + """ SELECT id, CAST(0 AS BIGINT) AS skills FROM postings WHERE NOT saved AND id NOT IN (SELECT p_partkey FROM part)
 UNION ALL SELECT id, CAST(2 AS BIGINT) FROM postings WHERE NOT saved AND id IN (SELECT p_partkey FROM part)""")
def delete_postings(spark, sf):
    p = derived.postings(spark, sf)
    detected = derived.table(spark, sf, "part").select(F.col("p_partkey").alias("job_id"), F.explode(F.split("p_name", " ")).alias("skill_name"))
    kept, skills = changes.delete_postings(p, detected, p.where("saved"))
    per_job = skills.groupBy(F.col("job_id").alias("id")).agg(F.count(F.lit(1)).alias("skills"))
    return kept.select("id").join(per_job, "id", "left").select("id", F.coalesce("skills", F.lit(0).cast("bigint")).alias("skills"))


@query("create_or_report_duplicate", PLAIN + """ SELECT url, id AS existing_id FROM postings WHERE status = 'F' UNION ALL SELECT url, NULL FROM postings WHERE status <> 'F'""")
def create_or_report_duplicate(spark, sf):
    p = derived.postings(spark, sf)
    new, duplicate = changes.split_duplicates(p.drop("id"), p.where("status = 'F'"))
    return duplicate.unionByName(new.select("url", F.lit(None).cast("bigint").alias("existing_id")))


@query("merge_enrichment", DESCRIBED + """ SELECT id, (trim(coalesce(description, '')) = '' OR len(skills_nice_to_have) = 0) AND id%2 = 0 AS enriched,
 CASE WHEN trim(coalesce(description, '')) = '' AND id%2 = 0 THEN 'parsed ' || title ELSE description END AS description,
 array_to_string(CASE WHEN (trim(coalesce(description, '')) = '' OR len(skills_nice_to_have) = 0) AND id%4 = 0 THEN ['Parsed'] ELSE skills_required END, '|') AS skills_required FROM postings""")
def merge_enrichment(spark, sf):
    p = derived.postings(spark, sf, skills=True, described=True)
    k = F.col("id")
    parsed = p.where(k % 2 == 0).select(
        "url", F.concat(F.lit("parsed "), "title").alias("description"),
        F.when(k % 4 == 0, F.array(F.lit("Parsed"))).alias("skills_required"), F.array().cast("array<string>").alias("skills_nice_to_have"),
    )
    return changes.merge_enrichment(p, parsed).select("id", "enriched", "description", F.array_join("skills_required", "|").alias("skills_required"))


@query("enrichment_backlog", DESCRIBED + """ SELECT id, url FROM postings WHERE trim(coalesce(description, '')) = '' AND contains(url, 'src1')""")
def enrichment_backlog(spark, sf):
    return changes.enrichment_backlog(derived.postings(spark, sf, described=True), F.contains(F.col("url"), F.lit("src1")))


@query("resume_history", """SELECT o_orderkey AS resume_id, o_custkey AS user_id, strftime(o_orderdate, '%Y-%m-%d') AS uploaded FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING'""")
def resume_history(spark, sf):
    users = derived.table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id"))
    kept = derived.table(spark, sf, "orders").select(F.col("o_orderkey").alias("resume_id"), F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("uploaded_at"))
    return listing.resume_history(users, kept).select("resume_id", "user_id", F.date_format("uploaded_at", "yyyy-MM-dd").alias("uploaded"))


# --- index ------------------------------------------------------------------------------------

_NEWEST = "(SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY company, lower(title) ORDER BY created_at DESC NULLS FIRST, id) AS rn FROM postings) WHERE rn = 1)"


@query("missing_from_index", PLAIN + f" SELECT id FROM postings WHERE id IN {_NEWEST} AND id NOT IN (SELECT doc_id FROM documents)")
def missing_from_index(spark, sf):
    selected = search_index.select_for_index(derived.postings(spark, sf), True)
    indexed = derived.table(spark, sf, "documents").select(F.col("doc_id").alias("job_id"))
    return search_index.missing_from_index(selected, indexed).select("id")


_RUNS = """WITH runs AS (SELECT o_orderkey AS run_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'failed' ELSE 'running' END AS status,
 CASE WHEN o_orderkey%2 = 0 THEN 'full' ELSE 'incremental' END AS mode, CAST(o_orderkey%7 AS BIGINT) AS target_total, CAST(o_orderkey%5 AS BIGINT) AS indexed,
 CASE WHEN o_orderkey%11 = 0 THEN 1 ELSE 0 END AS failed, CASE WHEN o_orderkey%13 <> 0 THEN 'idx' || o_orderkey ELSE ' ' END AS index_path,
 CASE WHEN o_orderkey%3 <> 0 THEN o_orderdate END AS activated_at FROM orders)"""


def _runs(spark, sf):
    k = F.col("o_orderkey")
    return derived.table(spark, sf, "orders").select(
        k.alias("run_id"), F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "failed").otherwise("running").alias("status"),
        F.when(k % 2 == 0, "full").otherwise("incremental").alias("mode"), (k % 7).alias("target_total"), (k % 5).alias("indexed"),
        F.when(k % 11 == 0, 1).otherwise(0).alias("failed"), F.when(k % 13 != 0, F.concat(F.lit("idx"), k)).otherwise(" ").alias("index_path"),
        F.when(k % 3 != 0, F.col("o_orderdate")).alias("activated_at"),
    )


@query("active_run", _RUNS + " SELECT run_id, mode, index_path FROM runs WHERE status = 'completed' AND activated_at IS NOT NULL ORDER BY activated_at DESC, run_id DESC LIMIT 1")
def active_run(spark, sf):
    return search_index.active_run(_runs(spark, sf)).select("run_id", "mode", "index_path")


@query("queryable_runs", _RUNS + """ SELECT run_id, (status = 'completed' AND activated_at IS NOT NULL AND failed = 0 AND trim(index_path) <> '' AND (mode <> 'full' OR (target_total > 0 AND indexed = target_total)) AND indexed > 0) AS queryable FROM runs""")
def queryable_runs(spark, sf):
    return _runs(spark, sf).select("run_id", search_index.is_queryable(F.col("indexed")).alias("queryable"))


# --- streams ------------------------------------------------------------------------------------

@query("streamed_inference_by_day", LOG + """ SELECT strftime(created_at, '%Y-%m-%d') AS day, model, CAST(count(*) AS BIGINT) AS count, CAST(sum(latency_ms) AS BIGINT) AS latency_sum,
 CAST(count(latency_ms) AS BIGINT) AS latency_count, CAST(coalesce(sum(input_tokens), 0) AS BIGINT) AS input_tokens,
 CAST(coalesce(sum(output_tokens), 0) AS BIGINT) AS output_tokens FROM log GROUP BY 1, 2""")
def streamed_inference_by_day(spark, sf):
    """The daily figures over the events as a stream, run to its end.

    Update mode: a trigger writes only the days it changed, and days behind the watermark leave
    the state.  The newest row of each (day, model) is the result.
    """
    events = spark.readStream.schema(spark.read.parquet(f"{sf}/events.parquet").schema).parquet(f"{sf}/events*.parquet")
    log = derived.inference_log_of(events).withColumn("created_at", F.col("created_at").cast("timestamp"))
    out = f"{ensure_checkpoint_dir(spark).rstrip('/')}/daily-{uuid.uuid4().hex}"

    def write(batch, number):
        batch.write.mode("overwrite").parquet(f"{out}/result/trigger={number}")

    daily_metrics(log).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{out}/result")
    fields = ["count", "latency_sum", "latency_count", "input_tokens", "output_tokens"]
    newest = rows.groupBy("day", "model").agg(F.max_by(F.struct(*fields), "trigger").alias("_r"))
    return newest.select("day", "model", "_r.*")
