"""Ordered pages of postings and the shapes they are served in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobweave import fixed_values as fv
from jobweave.functions.text import strings_or_empty
from jobweave.operators.dedup import KEY, attach_dup_count_to_page, newest_per_key, with_key
from jobweave.operators.filters import PostingFilter, apply_filters, facet_present
from jobweave.operators.paging import Order, page_of


def listing_order(sort_by: str | None = None) -> Order:
    """Sort columns of a listing, ending in id so that the order is total."""
    newest, last = ("created_at", "desc_nulls_first"), ("id", "asc")
    if sort_by == "salary_desc":
        return [("salary_max_pln", "desc_nulls_last"), newest, last]
    if sort_by == "salary_asc":
        return [("salary_min_pln", "asc_nulls_last"), newest, last]
    return [("date_added", "desc_nulls_first"), newest, last]


def select_postings(postings: DataFrame, f: PostingFilter | None = None, group_duplicates: bool = False) -> DataFrame:
    chosen = apply_filters(postings, f)
    return newest_per_key(chosen) if group_duplicates else chosen


def page_postings(
    postings: DataFrame,
    f: PostingFilter | None = None,
    *,
    page: int = 1,
    per_page: int = 50,
    sort_by: str | None = None,
    group_duplicates: bool = False,
) -> DataFrame:
    """One page with duplicate counts.  An early page is one top-k and a deep one reads its range of the order only."""
    if not 1 <= per_page <= fv.MAX_PAGE_SIZE or page < 1:
        raise ValueError(f"page starts at 1 and per_page is 1 to {fv.MAX_PAGE_SIZE}")
    chosen = select_postings(postings, f, group_duplicates)
    rows = page_of(chosen, listing_order(sort_by), page, per_page)
    return attach_dup_count_to_page(rows, postings)


def page_summary(
    postings: DataFrame, f: PostingFilter | None = None, *, per_page: int = 50, group_duplicates: bool = False
) -> DataFrame:
    """Total rows and pages of a listing."""
    chosen = apply_filters(postings, f)
    if group_duplicates:
        chosen = with_key(chosen).select(*KEY).distinct()
    return chosen.agg(F.count(F.lit(1)).alias("total")).select(
        "total",
        F.greatest(F.lit(1).cast("bigint"), F.ceil(F.col("total") / per_page)).alias("pages"),
    )


def nested_view(postings: DataFrame) -> DataFrame:
    """Served shape: salary as a struct or NULL, no NULL lists, flags or notes."""
    has = F.col("salary_min").isNotNull() | F.col("salary_max").isNotNull()
    salary = F.struct(
        F.col("salary_min").alias("min"), F.col("salary_max").alias("max"),
        F.col("salary_currency").alias("currency"), F.col("salary_type").alias("type"),
        F.col("salary_period").alias("period"), F.col("salary_min_pln").alias("min_pln"),
        F.col("salary_max_pln").alias("max_pln"),
    )
    lists = ["location", "skills_required", "skills_nice_to_have", "employment_types"]
    flat = ["id", "url", "source", "title", "company", "seniority", "work_type", "description", "category",
            "original_job_id", "date_published", "date_expires", "date_added", "status", "applied_date"]
    have = set(postings.columns)
    return postings.select(
        *[c for c in flat if c in have],
        *[strings_or_empty(F.col(c)).alias(c) for c in lists if c in have],
        F.when(has, salary).alias("salary"),
        F.coalesce("is_reposted", F.lit(False)).alias("is_reposted"),
        F.coalesce("saved", F.lit(False)).alias("saved"),
        F.coalesce("notes", F.lit("")).alias("notes"),
    )


def import_status_view(status: DataFrame) -> DataFrame:
    """Progress rows with zero defaults, the number of pending URLs and the percentage done."""
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    total, processed = count("total"), count("processed")
    return status.select(
        "source", "status", total.alias("total"), processed.alias("processed"),
        *[count(c).alias(c) for c in ("imported", "skipped", "errors")],
        strings_or_empty(F.col("error_log")).alias("error_log"),
        F.size(strings_or_empty(F.col("pending_urls"))).cast("bigint").alias("pending"),
        F.when(total > 0, F.floor(processed / total * 100 + 0.5)).otherwise(0).cast("bigint").alias("percent"),
    )


def distinct_values(postings: DataFrame, column: str) -> DataFrame:
    """Sorted facet values (category, work type or seniority)."""
    return postings.where(facet_present(column)).select(column).distinct().orderBy(column)


def top_values(values: DataFrame, column: str, limit: int | None, count: str = "count") -> DataFrame:
    """Values by falling count, name as the tie-break; a top-k, not a full sort."""
    counted = values.groupBy(column).agg(F.count(F.lit(1)).alias(count)).orderBy(F.desc(count), F.asc(column))
    return counted if limit is None else counted.limit(limit)


def top_locations(postings: DataFrame, limit: int = 50) -> DataFrame:
    return top_values(postings.select(F.explode("location").alias("location")), "location", limit)


def top_required_skills(postings: DataFrame, limit: int = 50) -> DataFrame:
    return top_values(postings.select(F.explode("skills_required").alias("skill")), "skill", limit)


def attach_detected_skills(page: DataFrame, postings: DataFrame, detected: DataFrame) -> DataFrame:
    """Skills detected in any duplicate of a row, distinct and sorted.

    ``page`` may be the whole table: (key, skill) pairs are made distinct before they are
    gathered, so a list never exceeds the dictionary.
    """
    from jobweave.operators.skew import attach_by_key

    found = detected.where("skill_name <> ''").select("job_id", "skill_name")
    pairs = (
        with_key(postings).select("id", *KEY).join(found, F.col("id") == F.col("job_id"))
        .select(*KEY, "skill_name").distinct()
    )
    wanted = with_key(page).groupBy(*KEY).agg(F.count(F.lit(1)).alias("_n"))
    lists = (
        pairs.join(wanted, KEY)
        .groupBy(*KEY).agg(F.max("_n").alias("_n"), F.array_sort(F.collect_list("skill_name")).alias("detected_skills"))
    )
    out = attach_by_key(with_key(page), lists, KEY, "_n", "id")
    return out.withColumn("detected_skills", strings_or_empty(F.col("detected_skills"))).drop("_n", "title_l")


def resume_history(users: DataFrame, resumes: DataFrame) -> DataFrame:
    """Resumes of the given users, newest first within a user."""
    from jobweave.operators.skew import broadcast_if_small

    mine = resumes.join(broadcast_if_small(users.select("user_id")), "user_id", "left_semi")
    return mine.orderBy("user_id", F.desc_nulls_first("uploaded_at"), "resume_id")
