"""The four "same posting" rules: newest per key, counts, repost tags, merged matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobweave import fixed_values as fv
from jobweave.operators.skew import attach_by_key, rows_with_keys

KEY = ["company", "title_l"]


def with_key(postings: DataFrame) -> DataFrame:
    """Add the duplicate key: exact company, lower-case title."""
    return postings.withColumn("title_l", F.lower("title"))


def newest_per_key(postings: DataFrame, keep_key: bool = False) -> DataFrame:
    """One posting per (company, lower(title)): latest created_at, NULL counts as latest.

    ``row_number() = 1`` lets Spark cut each map partition to one row per key before the
    shuffle (WindowGroupLimit), so a hot key does not reach one task in full.
    """
    order = Window.partitionBy(*KEY).orderBy(F.desc_nulls_first("created_at"), F.asc("id"))
    kept = with_key(postings).withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn")
    return kept if keep_key else kept.drop("title_l")


def dup_counts(postings: DataFrame) -> DataFrame:
    """Postings per key.  A null title or company is no key: it equals nothing, as in a join."""
    return with_key(postings).dropna(subset=KEY).groupBy(*KEY).agg(F.count(F.lit(1)).alias("dup_count"))


def attach_dup_count(rows: DataFrame, postings: DataFrame) -> DataFrame:
    """Number of postings that share the key, counted over the whole table."""
    joined = attach_by_key(with_key(rows), dup_counts(postings), KEY, "dup_count", "id")
    return joined.withColumn("dup_count", F.coalesce("dup_count", F.lit(1).cast("bigint"))).drop("title_l")


def attach_dup_count_to_page(page: DataFrame, postings: DataFrame) -> DataFrame:
    """Same for one page: only the keys of at most MAX_PAGE_SIZE rows are counted."""
    keyed = with_key(page)
    wanted = F.broadcast(keyed.select(*KEY).distinct())
    counts = with_key(postings).select(*KEY).join(wanted, KEY, "left_semi").groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("dup_count")
    )
    return keyed.join(F.broadcast(counts), KEY, "left").withColumn(
        "dup_count", F.coalesce("dup_count", F.lit(1).cast("bigint"))
    ).drop("title_l")


# --- other listings of the same role ---------------------------------------------

def _role(postings: DataFrame) -> DataFrame:
    """The role of a posting; where part of it is null it is nobody else's."""
    return postings.withColumns({"title_l": F.lower("title"), "company_l": F.lower("company")})


def alternate_counts(postings: DataFrame) -> DataFrame:
    """Per posting, how many listings of the same role other sources carry.

    Counted from (role, source) totals, so the pairs themselves are never formed.
    """
    role = ["company_l", "title_l"]
    per_source = _role(postings).dropna(subset=role).groupBy(*role, "source").agg(F.count(F.lit(1)).alias("_here"))
    totals = per_source.groupBy(*role).agg(F.sum("_here").alias("_all"))
    by_source = per_source.join(totals, role).select(
        *role, "source", "_here", (F.col("_all") - F.col("_here")).alias("alternates")
    )
    keys = role + ["source"]
    return attach_by_key(_role(postings).select("id", *keys), by_source, keys, "_here", "id").select(
        "id", "source", F.coalesce("alternates", F.lit(0).cast("bigint")).alias("alternates")
    )


def alternate_listings(postings: DataFrame, requested: DataFrame) -> DataFrame:
    """(job_id, alternate id, source, url) for the requested ids.

    The output is what the request asks for, so it grows with the request; for a whole
    table use ``alternate_counts`` or ``shared_roles``.
    """
    from jobweave.operators.skew import broadcast_if_small

    asked = _role(postings).join(
        broadcast_if_small(requested.select(F.col("job_id").alias("id"))), "id", "left_semi"
    ).select(F.col("id").alias("job_id"), F.col("source").alias("_source"), "company_l", "title_l")
    return (
        _role(postings).join(broadcast_if_small(asked), ["company_l", "title_l"])
        .where((F.col("id") != F.col("job_id")) & (F.col("source") != F.col("_source")))
        .select("job_id", "id", "source", "url")
    )


def shared_roles(postings: DataFrame) -> DataFrame:
    """Every listing whose role appears on two or more sources, with its role key.

    All alternates of a listing are the rows with its key and another source: the complete
    relation in linear size.
    """
    role = ["company_l", "title_l"]
    spread = (
        _role(postings).dropna(subset=role).groupBy(*role)
        .agg(F.min("source").alias("_a"), F.max("source").alias("_b"), F.count(F.lit(1)).alias("_n"))
        .where("_a <> _b").select(*role, F.col("_n").alias("listings"))
    )
    return attach_by_key(
        _role(postings).select("id", "source", "url", *role), spread, role, "listings", "id", how="inner"
    )


# --- reposts ---------------------------------------------------------------------

def tag_reposts(batch: DataFrame, committed: DataFrame | None = None) -> DataFrame:
    """Set is_reposted and original_job_id.

    ``batch`` carries ``batch_no``; ``committed`` rows count as an earlier batch.  A row is
    a repost when the earliest row of its (lower company, lower title) key was committed
    in an earlier batch, since rows of one batch do not see each other.
    """
    role = ["company_l", "title_l"]
    cols = ["batch_no", "created_at", "id", *role]
    seen = _role(batch).select(*cols).dropna(subset=role)
    if committed is not None:
        before = _role(committed).withColumn("batch_no", F.lit(-1).cast("bigint")).select(*cols)
        # Only roles of the batch matter, so the stored table is not aggregated in full.
        seen = seen.unionByName(rows_with_keys(before, _role(batch), role))
    # A NULL created_at sorts last, as in an ascending lookup.
    rank = F.struct(
        F.col("batch_no").cast("bigint").alias("batch_no"), F.col("created_at").isNull().alias("unknown"),
        F.col("created_at").alias("created_at"), F.col("id").alias("id"),
    )
    first = seen.groupBy(*role).agg(F.min(rank).alias("_first"), F.count(F.lit(1)).alias("_n"))
    tagged = attach_by_key(_role(batch), first, role, "_n", "id")
    earlier = F.col("_first.batch_no") < F.col("batch_no")
    return tagged.withColumns({
        "is_reposted": F.coalesce(earlier, F.lit(False)),
        "original_job_id": F.when(earlier, F.col("_first.id")),
    }).drop("_first", "_n", *role)


# --- ranked match lists ------------------------------------------------------------

def first_seen(matches: DataFrame, query: str, rank: str, limit: int | None = None) -> DataFrame:
    """Per query keep the first match of each (title, company); wholly blank keys go."""
    keyed = matches.withColumns({
        "_t": F.coalesce("title", F.lit("")), "_c": F.coalesce("company", F.lit("")),
    }).where("NOT (_t = '' AND _c = '')")
    per_key = Window.partitionBy(query, "_t", "_c").orderBy(rank, "job_id")
    firsts = keyed.withColumn("_rn", F.row_number().over(per_key)).where("_rn = 1")
    order = Window.partitionBy(query).orderBy(rank, "job_id")
    out = firsts.withColumn("position", F.row_number().over(order).cast("bigint"))
    if limit is not None:
        out = out.where(F.col("position") <= limit)
    return out.drop("_t", "_c", "_rn")


def merge_keyword_semantic(
    keyword: DataFrame, semantic: DataFrame, query: str = "query_id", limit: int | None = None
) -> DataFrame:
    """Keyword matches first, then semantic ones, one per (title, company); the first ``limit`` if given."""
    both = keyword.withColumn("leg", F.lit(0)).unionByName(
        semantic.withColumn("leg", F.lit(1)), allowMissingColumns=True
    )
    ranked = both.withColumn("_order", F.col("leg").cast("bigint") * F.lit(1 << 40) + F.col("rank"))
    return first_seen(ranked, query, "_order", limit).drop("_order")
