"""Batch ingest of parsed postings into the posting table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobweave import schema
from jobweave.functions.salary import normalize_salary
from jobweave.functions.text import all_skills, present, strip
from jobweave.operators.dedup import tag_reposts
from jobweave.operators.detect import detect_skills
from jobweave.operators.skew import rows_with_keys
from jobweave.session import cut_lineage, keep
from jobweave.sources.tables import BatchTable


def first_per_url(feed: DataFrame, position: str = "position") -> DataFrame:
    """First occurrence of each URL within the feed."""
    order = Window.partitionBy("url").orderBy(position)
    return feed.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn")


def valid_rows(parsed: DataFrame, *keep: str) -> tuple[DataFrame, DataFrame]:
    """(usable rows, rejects with error and the columns ``keep``): a row needs a URL, a title and a company."""
    error = F.concat_ws(
        "; ", *[F.when(~F.coalesce(present(F.col(c)), F.lit(False)), F.lit(f"missing {c}")) for c in ("url", "title", "company")]
    )
    marked = parsed.withColumn("error", error)
    return marked.where("error = ''").drop("error"), marked.where("error <> ''").select("url", "source", "error", *keep)


def too_long(parsed: DataFrame) -> DataFrame:
    """(url, source, error) of the skills that were too long to be listed; the postings themselves stay."""
    return parsed.select("url", "source", F.explode("dropped_skills").alias("_s")).select(
        "url", "source", F.concat(F.lit("skill too long: "), "_s").alias("error"))


def unseen(feed: DataFrame, postings: DataFrame) -> DataFrame:
    """Feed rows whose URL is not stored yet."""
    return feed.join(rows_with_keys(postings.select("url"), feed, ["url"]), "url", "left_anti")


def new_postings(feed: DataFrame, postings: DataFrame, *, now: str, rates: DataFrame | None = None) -> DataFrame:
    """Rows to append: unseen URLs, repost tags, monthly salary, status and stamps.

    ``feed`` carries batch_no; ``now`` is the run's timestamp text, so that a retry gives
    the same rows.  The id is a hash of the URL, which is the table's key.
    """
    # Read several times by the repost rule, so the batch is kept instead of parsed again.
    fresh = keep(
        unseen(feed, postings).withColumn("created_at", F.lit(now).cast("timestamp")).withColumn("id", posting_id())
    )
    return as_stored(tag_reposts(fresh, postings), now, rates)


def as_stored(tagged: DataFrame, now: str, rates: DataFrame | None = None) -> DataFrame:
    """Tagged new rows with monthly salary, status and stamps, in the table's schema."""
    paid = normalize_salary(tagged, rates, "explicit_period" if "explicit_period" in tagged.columns else None)
    return schema.conform(
        paid.withColumns({
            "status": F.lit("new"), "notes": F.lit(""), "saved": F.lit(False), "date_added": F.lit(now[:10]),
        }), schema.POSTING,
    )


def posting_id() -> "F.Column":
    """UUID-shaped id from the URL."""
    h = F.md5("url")
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def ingest_counts(feed: DataFrame, postings: DataFrame, rejects: DataFrame) -> DataFrame:
    """imported, skipped, errors and processed per source."""
    known = rows_with_keys(postings.select("url"), feed, ["url"]).distinct().withColumn("_known", F.lit(1))
    marks = (
        feed.select("source", "url").join(known, "url", "left")
        .select("source", F.coalesce("_known", F.lit(0)).alias("skip"), F.lit(0).alias("bad"))
        .unionByName(rejects.select("source", F.lit(0).alias("skip"), F.lit(1).alias("bad")))
    )
    return marks.groupBy("source").agg(
        F.count_if((F.col("skip") == 0) & (F.col("bad") == 0)).alias("imported"), F.count_if(F.col("skip") == 1).alias("skipped"),
        F.count_if(F.col("bad") == 1).alias("errors"), F.count(F.lit(1)).alias("processed"),
    )


def last_errors(rejects: DataFrame, order: str, keep: int | None = None) -> DataFrame:
    """Errors per source, or the latest ``keep`` of each."""
    if keep is None:
        return rejects
    w = Window.partitionBy("source").orderBy(F.desc(order), F.asc("url"))
    return rejects.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= keep).drop("_rn")


DICTIONARY = T.StructType([T.StructField("skill", T.StringType()), T.StructField("n", T.LongType())])
REJECT = T.StructType([T.StructField(c, T.StringType()) for c in ("url", "source", "error")])
AUDIT = T.StructType([
    T.StructField("source", T.StringType()), *[T.StructField(c, T.LongType()) for c in ("imported", "skipped", "errors", "processed", "batch")]])
PROCESSED = T.StructType([T.StructField("job_id", T.StringType())])


@dataclass
class PostingStore:
    """The tables an ingest run reads and appends to."""

    postings: BatchTable
    detected: BatchTable
    processed: BatchTable   # ids whose text was searched, with or without a hit
    audit: BatchTable
    rejects: BatchTable
    dictionary: BatchTable  # skill, n: how many more mentions a batch brought

    @classmethod
    def at(cls, spark, root: str) -> "PostingStore":
        kinds = {"postings": schema.POSTING, "detected": schema.DETECTED, "processed": PROCESSED, "audit": AUDIT, "rejects": REJECT, "dictionary": DICTIONARY}
        return cls(**{name: BatchTable(spark, f"{root}/{name}", kind) for name, kind in kinds.items()})

    def known_skills(self) -> DataFrame:
        """The skills that stored postings mention, from the batches' counts and not from the postings."""
        return self.dictionary.read().groupBy("skill").agg(F.sum("n").alias("n")).where("n > 0").select("skill")


def skill_mentions(postings: DataFrame) -> DataFrame:
    """(skill, n): mentions of each skill, as the dictionary counts them; the negative of it takes postings out."""
    each = postings.select(F.explode(all_skills()).alias("_s")).select(strip(F.col("_s")).alias("skill"))
    return each.where(present(F.col("skill"))).groupBy("skill").agg(F.count(F.lit(1)).alias("n"))


def ingest_batch(
    store: PostingStore, parsed: DataFrame, batch: int, now: str, rates: DataFrame | None = None,
    rejected: DataFrame | None = None, feed_name: str = "",
) -> None:
    """Append one batch.  Safe to repeat: every table skips a batch of the feed that it already has.

    ``parsed`` has a column ``position``, the same in every run, by which the first of several rows
    of a URL is taken.  ``feed_name`` tells feeds with batch numbers of their own apart.
    """
    if "position" not in parsed.columns:
        raise ValueError("a feed needs a column position that does not change when it is read again")
    if not store.postings.has_batch(feed_name, batch):
        usable, rejects = valid_rows(parsed)
        # Both are read several times; the feed is not parsed again for it.
        rejects = keep(rejects if rejected is None else rejects.unionByName(rejected))
        feed = keep(first_per_url(usable).withColumn("batch_no", F.lit(batch).cast("bigint")))
        before = store.postings.read()
        counts = ingest_counts(feed, before, rejects)
        dropped = too_long(feed) if "dropped_skills" in feed.columns else rejects.limit(0)
        commit_batch(store, new_postings(feed, before, now=now, rates=rates), counts, rejects.unionByName(dropped), batch, feed_name)
    else:
        commit_batch(store, None, None, None, batch, feed_name)


def commit_batch(
    store: PostingStore, new: DataFrame | None, counts: DataFrame | None, rejects: DataFrame | None, batch: int, feed_name: str,
) -> None:
    """Write what a batch brings: rejects, audit, postings, mentions, detected skills, searched ids.

    The postings come after what is counted against the earlier ones; what follows them is made from the
    batch's own stored rows, so a run that was cut short goes on where it stopped.
    """
    if new is not None:
        store.rejects.append(rejects, batch, feed_name)
        store.audit.append(counts.withColumn("batch", F.lit(batch).cast("bigint")), batch, feed_name)
        store.postings.append(new, batch, feed_name)
    todo = store.postings.read_batch(feed_name, batch)
    store.dictionary.append(skill_mentions(todo), batch, feed_name)
    if not store.detected.has_batch(feed_name, batch):
        # The ids are new and a batch has each once, so no pair is stored or found twice; pairs stay where they are found.
        found = detect_skills(todo, cut_lineage(store.known_skills()))
        store.detected.append(found, batch, feed_name)
    store.processed.append(todo.select(F.col("id").alias("job_id")), batch, feed_name)
