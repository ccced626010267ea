"""Listing filters (one parameter object -> one predicate over the posting table)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobweave import fixed_values as fv
from jobweave.functions.text import all_skills, is_blank, present


@dataclass(frozen=True)
class PostingFilter:
    """Every field is optional; unset fields do not filter."""

    status: str | None = None
    source: str | None = None
    category: str | None = None
    seniority: str | None = None
    skill: str | None = None
    skills: str | None = None
    search: str | None = None
    is_reposted: bool | None = None
    work_type: str | None = None
    location: str | None = None
    saved: bool | None = None


def comma_list(text: str | None) -> list[str]:
    return [part.strip() for part in (text or "").split(",") if part.strip()]


def contains_ci(column: str, fragment: str) -> Column:
    """Case-insensitive LIKE %fragment%; % and _ inside stay wildcards."""
    return F.col(column).ilike(f"%{fragment}%")


def has_all_skills(wanted: list[str]) -> Column:
    """Each wanted skill is in either list, exact case."""
    if len(wanted) > 8:
        return F.size(F.array_except(F.array(*[F.lit(s) for s in wanted]), all_skills())) == 0
    test = F.lit(True)
    for skill in wanted:
        either = F.coalesce(F.array_contains("skills_required", skill), F.lit(False)) | F.coalesce(
            F.array_contains("skills_nice_to_have", skill), F.lit(False)
        )
        test = test & either
    return test


def predicates(f: PostingFilter) -> list[Column]:
    tests: list[Column] = []
    if f.status:
        tests.append(F.col("status") == f.status)
    if f.saved is not None:
        tests.append(F.col("saved") == f.saved)
    if f.source:
        tests.append(contains_ci("source", f.source))
    if f.category:
        tests.append(F.col("category") == f.category)
    if f.seniority:
        levels = comma_list(f.seniority)
        tests.append(
            contains_ci("seniority", levels[0]) if len(levels) == 1
            else F.col("seniority").isin(levels) if levels else F.lit(False)
        )
    if f.work_type:
        tests.append(contains_ci("work_type", f.work_type))
    if f.location:
        tests.append(F.array_contains("location", f.location))
    wanted = comma_list(f.skills or f.skill)
    if wanted:
        tests.append(has_all_skills(wanted))
    if f.search:
        tests.append(
            contains_ci("title", f.search) | contains_ci("company", f.search)
            | contains_ci("description", f.search)
        )
    if f.is_reposted is not None:
        tests.append(F.col("is_reposted") == f.is_reposted)
    return tests


def apply_filters(postings: DataFrame, f: PostingFilter | None) -> DataFrame:
    for test in predicates(f or PostingFilter()):
        postings = postings.where(test)
    return postings


def facet_present(column: str) -> Column:
    """Value is there; for seniority the excluded levels are not."""
    test = present(F.col(column))
    if column == "seniority":
        test = test & ~F.col(column).isin(fv.SENIORITY_BLACKLIST)
    return test


def has_salary() -> Column:
    return F.col("salary_min").isNotNull() | F.col("salary_max").isNotNull()


def has_any_skill(skills: list[str]) -> Column:
    return F.arrays_overlap(all_skills(), F.array(*[F.lit(s) for s in skills]))


def missing_description(postings: DataFrame) -> DataFrame:
    return postings.where(is_blank(F.col("description")))


def within_days(events: DataFrame, stamp: str, as_of: Column | str, days: int = 7) -> DataFrame:
    """Rows of the ``days`` before ``as_of``, which is data and never the clock."""
    as_of = F.lit(as_of) if isinstance(as_of, str) else as_of
    return events.where(F.col(stamp) >= as_of - F.expr(f"INTERVAL {int(days)} DAYS"))


GRAM_LENGTHS = (16, 8, 4, 3, 2, 1)


def _grams(text: Column, n: int) -> Column:
    """The different stretches of ``n`` characters; none where the text is shorter."""
    starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, n)))


def find_by_url(postings: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each wanted URL: the exact posting, else the first one whose URL contains it.

    In a contained URL ``%`` and ``_`` are wildcards.  All steps are equi joins.  A wanted URL and those
    that contain it share a gram of its longest stretch without wildcards, of the longest of
    GRAM_LENGTHS that fits; the rest of it is checked on those that share it.  A stretch that is a gram
    whole needs no check, and one without any asks for a number of characters only: for these
    the smallest id of each gram, or length, is all that is joined.
    """
    from jobweave.operators.skew import broadcast_if_small

    urls = postings.select("id", "url")
    exact = urls.join(
        broadcast_if_small(wanted.select("wanted_url")), F.col("url") == F.col("wanted_url")
    ).groupBy("wanted_url").agg(F.min("id").alias("id"))
    clean = F.lower(F.regexp_replace("wanted_url", "/+$", ""))
    # A backslash that escapes nothing stands for itself.
    clean = F.regexp_replace(clean, r"\\(?![%_\\])", r"\\\\")
    literal = F.reverse(F.array_sort(F.transform(
        F.split(F.col("_clean"), r"[%_\\]"), lambda piece: F.struct(F.length(piece).alias("n"), piece.alias("piece")))))[0]
    sizes = F.array(*[F.lit(n) for n in GRAM_LENGTHS])
    rest = wanted.join(exact, "wanted_url", "left_anti").where("wanted_url IS NOT NULL").withColumn("_clean", clean).withColumn("_literal", literal)
    rest = rest.withColumn("_size", F.coalesce(F.get(F.filter(sizes, lambda n: n <= F.col("_literal.n")), 0), F.lit(0)))
    rest = rest.withColumn("_gram", F.expr("right(_literal.piece, _size)"))
    whole = F.length("_clean") == F.col("_size")  # the gram is all there is
    known = {r[0] for r in rest.select("_size").distinct().collect()}  # of the few lengths
    lower, parts = F.lower("url"), []
    for n in sorted(known - {0}):
        asked = rest.where(F.col("_size") == n)
        grams = urls.select("id", "url", F.explode(_grams(lower, n)).alias("_gram"))
        least = grams.join(broadcast_if_small(asked.where(whole).select("_gram").distinct()), "_gram").groupBy("_gram").agg(F.min("id").alias("id"))
        parts.append(asked.where(whole).join(broadcast_if_small(least), "_gram").select("wanted_url", "id"))
        checked = grams.join(broadcast_if_small(asked.where(~whole)), "_gram")
        parts.append(checked.where(F.expr("url ILIKE concat('%', _clean, '%')")).select("wanted_url", "id"))
    if 0 in known:  # wildcards alone: as many characters as there are underscores, or more
        by_length = urls.where("url IS NOT NULL").groupBy(F.length("url").alias("n")).agg(F.min("id").alias("id"))
        least = by_length.select("id", F.explode(F.sequence(F.lit(0), F.col("n"))).alias("_count")).groupBy("_count").agg(F.min("id").alias("id"))
        asked = rest.where("_size = 0").withColumn("_count", F.length(F.regexp_replace("_clean", "[^_]", "")))
        parts.append(asked.join(broadcast_if_small(least), "_count").select("wanted_url", "id"))
    found = exact.withColumn("exact", F.lit(True))
    if not parts:
        return found
    partial = parts[0]
    for part in parts[1:]:
        partial = partial.unionByName(part)
    return found.unionByName(partial.groupBy("wanted_url").agg(F.min("id").alias("id")).withColumn("exact", F.lit(False)))
