"""Skill vocabulary, skill statistics and skill-overlap matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobweave import fixed_values as fv
from jobweave.functions.numbers import percent
from jobweave.functions.text import all_skills, norm_skill, present, strip, strings_or_empty
from jobweave.operators.paging import page_of
from jobweave.operators.skew import attach_by_key, broadcast_if_small, fits_broadcast
from jobweave.session import cut_lineage, keep


def known_skills(postings: DataFrame) -> DataFrame:
    """Distinct trimmed skills of both lists; blank ones would match any text, so they go."""
    return (
        postings.select(F.explode(all_skills()).alias("_s"))
        .select(strip(F.col("_s")).alias("skill")).where(present(F.col("skill"))).distinct()
    )


def _tagged(postings: DataFrame, *carry: str) -> DataFrame:
    """Exploded skills with a flag for the required list; duplicates stay."""
    entries = F.concat(
        F.transform(strings_or_empty(F.col("skills_required")), lambda s: F.struct(s.alias("skill"), F.lit(1).alias("req"))),
        F.transform(strings_or_empty(F.col("skills_nice_to_have")), lambda s: F.struct(s.alias("skill"), F.lit(0).alias("req"))),
    )
    return postings.select(*carry, F.explode(entries).alias("_e")).select(*carry, "_e.skill", "_e.req")


def skill_counts(postings: DataFrame, category: str | None = None, search: str | None = None) -> DataFrame:
    """Per skill: count over both lists, required and nice-to-have counts."""
    base = postings.where(F.col("category") == category) if category else postings
    counted = (
        _tagged(base).where(strip(F.coalesce("skill", F.lit(""))) != "").groupBy("skill")
        .agg(
            F.count(F.lit(1)).alias("count"), F.sum("req").alias("required_count"),
            F.sum(1 - F.col("req")).alias("nice_count"),
        )
    )
    if search:
        counted = counted.where(F.lower("skill").contains(search.lower()))
    return counted


def skills_page(
    postings: DataFrame, *, page: int = 1, per_page: int = 50, category: str | None = None, search: str | None = None
) -> DataFrame:
    """One page of skills by falling count, with global rank and shares of the top count."""
    counted = skill_counts(postings, category, search)
    order = [F.desc("count"), F.asc("skill")]
    rows = page_of(counted, [("count", "desc"), ("skill", "asc")], page, per_page)
    # At most per_page rows are left, so one unpartitioned window is bounded.
    everything = Window.partitionBy(F.lit(1))
    return rows.select(
        strip(F.col("skill")).alias("skill"), "count", "required_count",
        (F.row_number().over(everything.orderBy(*order)) + (page - 1) * per_page).cast("bigint").alias("rank"),
        percent(F.col("count"), F.max("count").over(everything)).alias("share"),
        percent(F.col("required_count"), F.max("count").over(everything)).alias("required_share"),
    )


def skills_totals(
    postings: DataFrame, *, per_page: int = 50, category: str | None = None, search: str | None = None
) -> DataFrame:
    """total_jobs, total_skills and pages of the summary."""
    base = postings.where(F.col("category") == category) if category else postings
    jobs = base.agg(F.count(F.lit(1)).alias("total_jobs"))
    skills = skill_counts(postings, category, search).agg(F.count(F.lit(1)).alias("total_skills"))
    # Two one-row aggregates side by side.
    return jobs.withColumn("_k", F.lit(1)).join(skills.withColumn("_k", F.lit(1)), "_k").select(
        "total_jobs", "total_skills",
        F.greatest(F.lit(1).cast("bigint"), F.ceil(F.col("total_skills") / per_page)).alias("pages"),
    )


def top_listed_skills(postings: DataFrame, column: str, top: int = 30, category: str | None = None) -> DataFrame:
    """Top skills of one list; blank names take a place before they are dropped."""
    base = postings.where(F.col("category") == category) if category else postings
    ranked = (
        base.select(F.explode(column).alias("skill")).groupBy("skill").agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), F.asc("skill")).limit(top)
    )
    return ranked.where(strip(F.coalesce("skill", F.lit(""))) != "").select(strip(F.col("skill")).alias("skill"), "count")


# --- category profiles and resume scores ------------------------------------------

def category_skills(postings: DataFrame, min_jobs: int = 1) -> DataFrame:
    """(category, skill_n, display, weight, required, job_count, total_weight).

    ``display`` is the smallest raw form, since first-seen has no meaning in a distributed
    table.  A caller may leave out categories below ``min_jobs`` postings; a category without any
    skill yields one row with a NULL skill and total 0.
    """
    base = postings.withColumn("category", strip(F.coalesce("category", F.lit("")))).where("category <> ''")
    jobs = base.groupBy("category").agg(F.count(F.lit(1)).alias("job_count")).where(F.col("job_count") >= min_jobs)
    weights = (
        _tagged(base, "category").where(present(F.col("skill")))
        .groupBy("category", norm_skill(F.col("skill")).alias("skill_n"))
        .agg(F.min("skill").alias("display"), F.count(F.lit(1)).alias("weight"), (F.max("req") == 1).alias("required"))
    )
    totals = weights.groupBy("category").agg(F.sum("weight").alias("total_weight"))
    heads = jobs.join(totals, "category", "left").withColumn(
        "total_weight", F.coalesce("total_weight", F.lit(0).cast("bigint"))
    )
    return heads.join(weights, "category", "left")


def resume_skills_n(resume_skills: DataFrame) -> DataFrame:
    """Distinct (resume_id, skill_n)."""
    return resume_skills.select("resume_id", norm_skill(F.col("skill")).alias("skill_n")).where("skill_n <> ''").distinct()


def category_scores(postings: DataFrame, resume_skills: DataFrame, min_jobs: int = 1) -> DataFrame:
    """(resume_id, category, job_count, match_score, matching_skills): one row for every resume and
    category that share a skill; lists by falling weight.

    The profile (categories x vocabulary) is computed once and kept; it is measured before
    it is broadcast.  Categories without a shared skill have score 0 and no row; ``scores_of``
    gives one for pairs that are asked for.
    """
    profile = cut_lineage(category_skills(postings, min_jobs))
    mine = resume_skills_n(resume_skills)
    matched = (
        mine.join(broadcast_if_small(profile.where("skill_n IS NOT NULL").select("category", "skill_n", "display", "weight")), "skill_n")
        .groupBy("resume_id", "category")
        .agg(
            F.sum("weight").alias("matched_weight"),
            F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), "display"))).alias("_m"),
        )
    )
    heads = profile.select("category", "job_count", "total_weight").distinct()
    share = F.rint(F.col("matched_weight") / F.col("total_weight") * 100)
    return matched.join(broadcast_if_small(heads), "category").select(
        "resume_id", "category", "job_count", F.least(F.lit(100), share).cast("bigint").alias("match_score"),
        F.transform("_m", lambda e: F.struct(e["display"].alias("skill"), (-e["w"]).alias("weight"))).alias("matching_skills"),
    )


def scores_of(pairs: DataFrame, scores: DataFrame) -> DataFrame:
    """(resume_id, category, match_score) of the asked pairs, 0 where they share no skill."""
    found = scores.select("resume_id", "category", "match_score")
    return pairs.select("resume_id", "category").join(found, ["resume_id", "category"], "left").withColumn(
        "match_score", F.coalesce("match_score", F.lit(0).cast("bigint")))


def skills_to_add(
    postings: DataFrame, resume_skills: DataFrame, *, limit: int | None = None, min_weight: int = 1, min_jobs: int = 1,
) -> DataFrame:
    """(resume_id, category, position, skill, weight): the heaviest skills that a resume lacks in each
    category it shares a skill with.

    With a limit, a pair with m shared skills finds its top ``limit`` missing ones among the
    category's first ``limit + m``, so the pair meets no more than those; rows are made for pairs that share a
    skill only.  Without a limit every missing skill is a row of the result.
    """
    profile = cut_lineage(category_skills(postings, min_jobs).where("skill_n IS NOT NULL"))
    order = [F.desc("weight"), F.asc("display"), F.asc("skill_n")]
    shared = resume_skills_n(resume_skills).join(broadcast_if_small(profile.select("category", "skill_n")), "skill_n")
    pairs = cut_lineage(shared.groupBy("resume_id", "category").agg(F.collect_set("skill_n").alias("_has")))
    by_weight = Window.partitionBy("category").orderBy(*order)
    ranked = profile.where(F.col("weight") >= min_weight).select("category", "skill_n", "display", "weight")
    if limit is not None:
        most = pairs.agg(F.max(F.size("_has"))).first()[0] or 0
        ranked = ranked.withColumn("_rn", F.row_number().over(by_weight)).where(F.col("_rn") <= limit + most)
    ranked = cut_lineage(ranked)
    near = F.lit(True) if limit is None else F.col("_rn") <= limit + F.size("_has")
    lacking = pairs.join(broadcast_if_small(ranked), "category").where(near & ~F.array_contains("_has", F.col("skill_n")))
    per_pair = Window.partitionBy("resume_id", "category").orderBy(*order)
    out = lacking.withColumn("position", F.row_number().over(per_pair).cast("bigint"))
    if limit is not None:
        out = out.where(F.col("position") <= limit)
    return out.select("resume_id", "category", "position", F.col("display").alias("skill"), "weight")


def top_categories(scores: DataFrame, limit: int = 10) -> DataFrame:
    """Best categories per resume by match score."""
    order = Window.partitionBy("resume_id").orderBy(F.desc("match_score"), F.asc("category"))
    return scores.withColumn("position", F.row_number().over(order).cast("bigint")).where(F.col("position") <= limit)


def score_from_lists(matching: Column, to_add: Column) -> Column:
    """Share of matched weight where an answer carries only the two lists; browser rounding."""
    total = lambda arr: F.aggregate(arr, F.lit(0).cast("bigint"), lambda acc, e: acc + e["weight"])
    return percent(total(matching), total(matching) + total(to_add))


# --- skill overlap ------------------------------------------------------------------

def _normalized_names(trim: bool = True) -> Column:
    """Normalized distinct skills of a posting, sorted."""
    norm = norm_skill if trim else F.lower
    names = F.filter(F.transform(all_skills(), lambda s: norm(s)), lambda s: s.isNotNull() & (s != ""))
    return F.array_sort(F.array_distinct(names))


def skill_differences(postings: DataFrame, resume_skills: DataFrame, pairs: DataFrame) -> DataFrame:
    """(resume_id, job_id, common, missing) for given pairs: skills of the posting the resume
    has, and those it lacks."""
    listed = postings.select(F.col("id").alias("job_id"), _normalized_names().alias("listed"))
    return (
        pairs.join(_wanted_sets(resume_skills), "resume_id").join(listed, "job_id")
        .select("resume_id", "job_id", F.array_intersect("listed", "wanted").alias("common"), F.array_except("listed", "wanted").alias("missing"))
    )


def _wanted_sets(resume_skills: DataFrame) -> DataFrame:
    return resume_skills_n(resume_skills).groupBy("resume_id").agg(F.array_sort(F.collect_set("skill_n")).alias("wanted"))


def _shown(trim: bool) -> Column:
    """Matched skills in the posting's last spelling, sorted."""
    if not trim:
        return F.array_sort(F.array_intersect("wanted", F.array_distinct(F.transform("raw", lambda s: F.lower(s)))))
    spelled = F.transform("raw", lambda s: F.struct(norm_skill(s).alias("n"), s.alias("raw")))
    common = F.array_intersect("wanted", F.transform(spelled, lambda e: e["n"]))
    return F.array_sort(F.transform(
        common, lambda m: F.element_at(F.filter(spelled, lambda e: e["n"] == m), -1)["raw"]
    ))


def _resume_sets(people: DataFrame, column: str) -> DataFrame:
    """(wanted_id, column, resumes): distinct skill sets, named by their smallest resume."""
    return people.groupBy(column).agg(F.min("resume_id").alias("wanted_id"), F.count(F.lit(1)).alias("_resumes"))


def _posting_sets(postings: DataFrame, names: Column, limit: int | None) -> DataFrame:
    """(set_id, job_id, nth, names, raw): the first ``limit`` postings of each distinct skill
    set, which is called by its smallest posting id."""
    raw = all_skills()
    order = Window.partitionBy("names").orderBy("job_id")
    ranked = (
        postings.select(F.col("id").alias("job_id"), names.alias("names"), raw.alias("raw")).where(F.size("names") > 0)
        .withColumn("nth", F.row_number().over(order))
    )
    return _up_to(ranked, "nth", limit).withColumn("set_id", F.first("job_id").over(order))


def _up_to(ranked: DataFrame, rank: str, limit: int | None) -> DataFrame:
    return ranked if limit is None else ranked.where(F.col(rank) <= limit)


FIRST_LOOK = 4  # so many times the limit of sets are looked at for each skill, to find a bound


def best_overlaps(sets: DataFrame, wanted: DataFrame, limit: int | None, fits: Column | None = None) -> DataFrame:
    """(wanted_id, set_id, match_count) of at least the ``limit`` sets with the largest overlap, for each wanted set.

    ``sets`` has set_id and ``names``, ``wanted`` has wanted_id and ``wanted``, both lists without repeats; ``fits`` is a
    further condition on a pair.  Equal overlaps are ordered by set_id.

    A first look at the first few sets of every skill gives each wanted set a bound: at the limit it
    has an overlap of t, or t and a set_id up to some last one.  A set with an overlap of t
    holds one of the n - t + 1 rarest of n wanted skills, and one with more than t one of the n - t rarest; so
    only the postings of those skills are looked at, for the last of them up to the last set_id,
    and no other pair is ever made.  Without a limit all overlapping pairs are wanted, and made.
    """
    listed = cut_lineage(sets.select("*", F.explode("names").alias("skill_n")))
    often = listed.groupBy("skill_n").agg(F.count(F.lit(1)).alias("_df"))
    rarest = Window.partitionBy("wanted_id").orderBy("_df", "skill_n")
    asked = wanted.select("*", F.explode("wanted").alias("skill_n")).join(often, "skill_n").withColumns({
        "_at": F.row_number().over(rarest),
        "_n": F.count(F.lit(1)).over(Window.partitionBy("wanted_id")),
        "_rarer": F.collect_list("skill_n").over(rarest.rowsBetween(Window.unboundedPreceding, -1)),
    }).drop("_df")
    common = F.size(F.array_intersect("names", "wanted")).cast("bigint")
    fits = F.lit(True) if fits is None else fits
    if limit is None:
        asked = asked.withColumns({"_t": F.lit(1).cast("bigint"), "_last": F.lit(None).cast(sets.schema["set_id"].dataType)})
    else:
        asked = cut_lineage(asked)
        by_id = Window.partitionBy("skill_n").orderBy("set_id")
        first = listed.withColumn("_nth", F.row_number().over(by_id)).where(F.col("_nth") <= FIRST_LOOK * limit).drop("_nth")
        seen = first.join(broadcast_if_small(asked), "skill_n").where(fits).select("wanted_id", "set_id", common.alias("_t")).distinct()
        order = Window.partitionBy("wanted_id").orderBy(F.desc("_t"), "set_id")
        bound = cut_lineage(seen.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= limit)).where(F.col("_rank") == limit)
        bound = broadcast_if_small(bound.select("wanted_id", "_t", F.col("set_id").alias("_last")))
        asked = asked.join(bound, "wanted_id", "left").withColumn("_t", F.coalesce("_t", F.lit(1).cast("bigint")))
    asked = asked.where(F.col("_at") <= F.col("_n") - F.col("_t") + 1)
    in_time = F.col("_last").isNull() | (F.col("set_id") <= F.col("_last"))
    # A pair is made at the rarest skill that both hold, so it is made once.
    met = listed.join(broadcast_if_small(cut_lineage(asked)), "skill_n").where(
        ((F.col("_at") <= F.col("_n") - F.col("_t")) | in_time) & ~F.arrays_overlap("names", "_rarer") & fits)
    met = met.select("wanted_id", "set_id", common.alias("match_count"), "_t", in_time.alias("_in_time"))
    return met.where((F.col("match_count") > F.col("_t")) | ((F.col("match_count") == F.col("_t")) & F.col("_in_time"))).select(
        "wanted_id", "set_id", "match_count")


def _best_jobs(overlaps: DataFrame, sets: DataFrame, limit: int | None) -> DataFrame:
    """(wanted_id, rank, job_id, match_count, raw) from (wanted_id, set_id, match_count).

    A set behind ``limit`` others by (count, first id) has all its ids behind theirs, so the
    first cut is by set; it happens per partition before any pair moves.
    """
    by_set = Window.partitionBy("wanted_id").orderBy(F.desc("match_count"), F.asc("set_id"))
    kept = overlaps if limit is None else overlaps.withColumn("_rn", F.row_number().over(by_set)).where(F.col("_rn") <= limit).drop("_rn")
    by_job = Window.partitionBy("wanted_id").orderBy(F.desc("match_count"), F.asc("job_id"))
    joined = sets.select("set_id", "job_id", "raw").join(kept, "set_id")
    return _up_to(joined.withColumn("rank", F.row_number().over(by_job).cast("bigint")), "rank", limit)


def _per_resume(people: DataFrame, column: str, resume_sets: DataFrame, hits: DataFrame, size: Column, *extra: str) -> DataFrame:
    """Hand the bounded list of each resume set to every resume that has the set."""
    fields = ["rank", "job_id", "match_count", *extra]
    lists = (
        hits.groupBy("wanted_id").agg(F.collect_list(F.struct(*fields)).alias("_hits"))
        .join(resume_sets.select("wanted_id", column), "wanted_id").drop("wanted_id")
    )
    joined = attach_by_key(
        people, lists, [column], "_resumes", "resume_id", "inner", resume_sets.select(column, "_resumes")
    )
    return joined.select("resume_id", size.alias("_n"), F.explode("_hits").alias("_h")).select(
        "resume_id", "_h.rank", "_h.job_id", "_h.match_count", (F.col("_h.match_count") / F.col("_n")).alias("match_ratio"),
        *[F.col(f"_h.{c}").alias(c) for c in extra],
    )


def match_postings(postings: DataFrame, resume_skills: DataFrame, limit: int | None, *, trim: bool = True) -> DataFrame:
    """(resume_id, rank, job_id, match_count, match_ratio, matched_skills), the best ``limit`` each, or all that share a skill.

    Postings with the same skill set score alike, and resumes with the same skill set get
    the same list, so both sides are reduced to distinct sets; of a posting set only its
    first ``limit`` ids can be in anyone's list.  ``trim=False`` only lower-cases the posting's skills.
    """
    people = cut_lineage(_wanted_sets(resume_skills))
    wanted = cut_lineage(_resume_sets(people, "wanted"))
    sets = cut_lineage(_posting_sets(postings, _normalized_names(trim), limit))
    overlaps = best_overlaps(sets.where("nth = 1").select("set_id", "names"), wanted.select("wanted_id", "wanted"), limit)
    hits = _best_jobs(overlaps, sets, limit).join(wanted.select("wanted_id", "wanted"), "wanted_id")
    spelled = hits.select("wanted_id", "rank", "job_id", "match_count", _shown(trim).alias("matched_skills"))
    return _per_resume(people, "wanted", wanted, spelled, F.size("wanted"), "matched_skills")


def match_postings_exact_case(postings: DataFrame, resume_skills: DataFrame, limit: int | None) -> DataFrame:
    """As ``match_postings``, but a posting must hold one resume skill in its exact case.

    Sets are kept apart by their raw spelling here.
    """
    normal = lambda arr: F.array_distinct(F.transform(arr, lambda s: norm_skill(s)))
    typed = resume_skills.select("resume_id", F.trim("skill").alias("skill")).where("skill <> ''")
    people = cut_lineage(typed.groupBy("resume_id").agg(F.array_sort(F.collect_set("skill")).alias("exact")))
    wanted = cut_lineage(_resume_sets(people, "exact"))
    spelled = F.array_sort(F.array_distinct(F.filter(all_skills(), lambda s: s.isNotNull() & (s != ""))))
    sets = cut_lineage(_posting_sets(postings, spelled, limit))
    listed = sets.where("nth = 1").select("set_id", normal(F.col("names")).alias("names"), F.col("names").alias("_spelled"))
    asked = wanted.select("wanted_id", normal(F.col("exact")).alias("wanted"), F.col("exact").alias("_exact"))
    overlaps = best_overlaps(listed, asked, limit, F.arrays_overlap("_spelled", "_exact"))
    return _per_resume(people, "exact", wanted, _best_jobs(overlaps, sets, limit), F.size(normal(F.col("exact"))))


def with_extra_keywords(found: DataFrame, extra: DataFrame) -> DataFrame:
    """Distinct (resume_id, keyword) of both; ``found`` has each once, as ``detect.keywords`` gives them.

    Where the extra ones can be broadcast, they are taken out of the found ones as these are made, and no found one is shuffled.
    """
    more = extra.select("resume_id", "keyword").distinct()
    if not fits_broadcast(more):
        return found.unionByName(more).distinct()
    named = F.broadcast(more.select(F.col("resume_id").alias("_id"), F.col("keyword").alias("_keyword")))
    on = F.col("resume_id").eqNullSafe(F.col("_id")) & F.col("keyword").eqNullSafe(F.col("_keyword"))
    return found.join(named, on, "left_anti").unionByName(more)


def canonical_resume_skills(keywords: DataFrame, known: DataFrame, raw_limit: int | None = None) -> DataFrame:
    """(resume_id, skill): keywords known to the postings, in their listed spelling; a
    resume with none keeps its keywords, or the first ``raw_limit`` in order.

    Keywords stay where they are made, and are made once: only known skills, and one row for each resume, are shuffled and kept.
    """
    spelled = known.groupBy(norm_skill(F.col("skill")).alias("key")).agg(F.max("skill").alias("canonical"))
    tagged = keywords.withColumn("key", norm_skill(F.col("keyword"))).join(
        broadcast_if_small(cut_lineage(spelled)), "key", "left"
    )
    # A resume's unknown keywords are one row here.
    seen = keep(tagged.select("resume_id", "canonical").distinct())
    hits = seen.where("canonical IS NOT NULL").select("resume_id", F.col("canonical").alias("skill"))
    none = cut_lineage(seen.groupBy("resume_id").agg(F.count("canonical").alias("n")).where("n = 0").select("resume_id"))
    if none.isEmpty():
        return hits
    raw = keywords.where("keyword <> ''").join(broadcast_if_small(none), "resume_id", "left_semi").select("resume_id", "keyword").distinct()
    if raw_limit is not None:
        order = Window.partitionBy("resume_id").orderBy("keyword")
        raw = raw.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= raw_limit)
    return hits.unionByName(raw.where(F.length("keyword") >= 2).select("resume_id", F.col("keyword").alias("skill")))
