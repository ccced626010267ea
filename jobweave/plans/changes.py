"""Edits of stored postings as joins: updates, deletes, inserts, backfills, enrichment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobweave.functions.salary import normalize_salary
from jobweave.functions.text import format_category, is_blank, strings_or_empty
from jobweave.operators.filters import has_salary, missing_description
from jobweave.operators.skew import broadcast_if_small, fits_broadcast, rows_with_keys

EDITABLE = ["status", "applied_date", "notes", "is_reposted", "saved"]


def apply_changes(postings: DataFrame, changes: DataFrame, today: str, at: str | None = None) -> DataFrame:
    """Partial update by id; NULL fields of ``changes`` leave the stored value.

    A status set to applied without a date gets ``today``.  Postings without a change pass
    through; changes are few, so they are measured and broadcast.  ``at`` names the column that orders
    several edits of one posting; without it the larger value counts.
    """
    fields = [c for c in EDITABLE if c in changes.columns]
    order = F.col(at) if at else F.lit(0)
    # Of several edits of a posting the latest that gives a value counts, field by field.
    new = changes.groupBy("id").agg(*[
        F.max(F.when(F.col(c).isNotNull(), F.struct(order.alias("at"), F.col(c).alias("value"))))["value"].alias(f"_new_{c}") for c in fields])
    have = {c for c in EDITABLE if c in changes.columns}
    joined = postings.join(broadcast_if_small(new), "id", "left")
    updates = {c: F.coalesce(F.col(f"_new_{c}"), F.col(c)) for c in have if c in postings.columns}
    if "status" in have and "applied_date" in postings.columns:
        given = F.col("_new_applied_date") if "applied_date" in have else F.lit(None).cast("string")
        stamp = F.when((F.col("_new_status") == "applied") & (F.coalesce(given, F.lit("")) == ""), F.lit(today))
        # An empty date is a given value: it replaces the stamp, as an edit of it would.
        updates["applied_date"] = F.coalesce(given, stamp, F.col("applied_date"))
    return joined.withColumns(updates).select(*postings.columns)


def delete_postings(postings: DataFrame, detected: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remaining postings and detected skills once ``ids`` are gone."""
    gone = broadcast_if_small(ids.select("id"))
    kept_skills = detected.join(gone.select(F.col("id").alias("job_id")), "job_id", "left_anti")
    return postings.join(gone, "id", "left_anti"), kept_skills


def split_duplicates(incoming: DataFrame, postings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new rows, duplicate report with existing_id), by URL."""
    known = rows_with_keys(postings.select("url", F.col("id").alias("existing_id")), incoming, ["url"])
    matched = incoming.join(known, "url", "left")
    return (
        matched.where("existing_id IS NULL").drop("existing_id"),
        matched.where("existing_id IS NOT NULL").select("url", "existing_id"),
    )


def backfill_categories(postings: DataFrame) -> DataFrame:
    """Normalized category and a ``fixed`` flag on rows it changed."""
    new = F.when(F.coalesce("category", F.lit("")) != "", format_category(F.col("category")))
    fixed = F.coalesce(new.isNotNull() & (new != F.col("category")), F.lit(False))
    return postings.withColumn("_new", new).withColumn("fixed", fixed).withColumn(
        "category", F.when(F.col("fixed"), F.col("_new")).otherwise(F.col("category"))
    ).drop("_new")


def backfill_salaries(postings: DataFrame, rates: DataFrame | None = None) -> DataFrame:
    """Recompute period and monthly range where a bound is present; others stay."""
    stored = postings
    for c, kind in (("salary_period", "string"), ("salary_min_pln", "double"), ("salary_max_pln", "double")):
        if c not in stored.columns:
            stored = stored.withColumn(c, F.lit(None).cast(kind))
    kept = {c: F.col(c) for c in ("salary_period", "salary_min_pln", "salary_max_pln")}
    old = stored.withColumns({f"_old_{c}": v for c, v in kept.items()})
    new = normalize_salary(old, rates).withColumn("updated", has_salary())
    return new.withColumns({c: F.when(F.col("updated"), F.col(c)).otherwise(F.col(f"_old_{c}")) for c in kept}).drop(
        *[f"_old_{c}" for c in kept]
    )


def needs_enrichment() -> "F.Column":
    return is_blank(F.col("description")) | (F.size(strings_or_empty(F.col("skills_nice_to_have"))) == 0)


def merge_enrichment(postings: DataFrame, parsed: DataFrame, at: str | None = None) -> DataFrame:
    """Fill a blank description and replace skill lists by non-empty parsed ones.

    ``parsed``: url, description, skills_required, skills_nice_to_have.  ``enriched`` flags
    the rows that were eligible and had a parsed page; ``at`` names the column that orders repeated crawls.
    """
    # One parsed page per address: of repeated crawls the latest, or with the longest description.
    order = F.struct(F.col(at) if at else F.lit(0), F.length(F.coalesce("description", F.lit(""))), "description", "skills_required", "skills_nice_to_have")
    new = parsed.groupBy("url").agg(F.max_by(F.struct("description", "skills_required", "skills_nice_to_have"), order).alias("_p")).select(
        "url", F.col("_p.description").alias("_d"), F.col("_p.skills_required").alias("_r"), F.col("_p.skills_nice_to_have").alias("_n"),
        F.lit(True).alias("_hit"),
    )
    # The pages as they are bound what is left of them, and are measured without bringing them together first.
    small = fits_broadcast(parsed.select("url", "description", "skills_required", "skills_nice_to_have"))
    joined = postings.join(F.broadcast(new) if small else new, "url", "left")
    enriched = needs_enrichment() & F.coalesce("_hit", F.lit(False))
    longer = lambda c: F.col("enriched") & (F.size(strings_or_empty(F.col(c))) > 0)
    return (
        joined.withColumn("enriched", enriched)
        .withColumns({
            "description": F.when(
                F.col("enriched") & is_blank(F.col("description")) & (F.coalesce("_d", F.lit("")) != ""), F.col("_d")
            ).otherwise(F.col("description")),
            "skills_required": F.when(longer("_r"), F.col("_r")).otherwise(F.col("skills_required")),
            "skills_nice_to_have": F.when(longer("_n"), F.col("_n")).otherwise(F.col("skills_nice_to_have")),
        })
        .drop("_d", "_r", "_n", "_hit")
    )


def enrichment_backlog(postings: DataFrame, supported: "F.Column", limit: int | None = None) -> DataFrame:
    """Postings without description on a supported board; ``limit``, if given, is the size of one run."""
    backlog = missing_description(postings).where(supported)
    return backlog.select("id", "url") if limit is None else backlog.orderBy("id").limit(limit).select("id", "url")
