"""Scan, filters, duplicates, pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobweave.catalog import query
from jobweave.catalog.views import DESCRIBED, PAID, PLAIN, SKILLED
from jobweave.operators import dedup, filters, listing
from jobweave.operators.filters import PostingFilter
from jobweave.sources import derived

_COLS = ["id", "url", "title", "company"]


@query("scan_postings", SKILLED + """
SELECT id, url, source, title, company, array_to_string(location, '|') AS location, salary_min, salary_max, salary_currency,
 salary_type, array_to_string(skills_required, '|') AS skills_required, array_to_string(skills_nice_to_have, '|') AS skills_nice_to_have,
 seniority, work_type, category, is_reposted, date_added, status, saved FROM postings""")
def scan_postings(spark, sf):
    p = derived.postings(spark, sf, skills=True)
    text = lambda c: F.array_join(c, "|").alias(c)
    return p.select(
        "id", "url", "source", "title", "company", text("location"), "salary_min", "salary_max", "salary_currency", "salary_type",
        text("skills_required"), text("skills_nice_to_have"), "seniority", "work_type", "category", "is_reposted", "date_added",
        "status", "saved",
    )


def _filtered(name: str, f: PostingFilter, where: str, skills: bool = False, described: bool = False) -> None:
    prefix = DESCRIBED if described else SKILLED if skills else PLAIN

    @query(name, f"{prefix} SELECT {', '.join(_COLS)} FROM postings WHERE {where}")
    def run(spark, sf):
        p = derived.postings(spark, sf, skills=skills, described=described)
        return filters.apply_filters(p, f).select(*_COLS)


_filtered("filter_status", PostingFilter(status="F"), "status = 'F'")
_filtered("filter_saved", PostingFilter(saved=True), "saved = true")
_filtered("filter_not_saved", PostingFilter(saved=False), "saved = false")
_filtered("filter_source_contains", PostingFilter(source="SRC1"), "source ILIKE '%SRC1%'")
_filtered("filter_category", PostingFilter(category="BUILDING"), "category = 'BUILDING'")
_filtered("filter_seniority_one", PostingFilter(seniority="low"), "seniority ILIKE '%low%'")
_filtered("filter_seniority_many", PostingFilter(seniority="1-URGENT, 5-LOW"), "seniority IN ('1-URGENT', '5-LOW')")
_filtered("filter_work_type", PostingFilter(work_type="rem"), "work_type ILIKE '%rem%'")
_filtered("filter_location", PostingFilter(location="NATION_3"), "list_contains(location, 'NATION_3')")
_filtered(
    "filter_all_skills", PostingFilter(skill="ignored", skills="ring, ECONOMY"),
    "(list_contains(skills_required,'ring') OR list_contains(skills_nice_to_have,'ring')) AND "
    "(list_contains(skills_required,'ECONOMY') OR list_contains(skills_nice_to_have,'ECONOMY'))", skills=True,
)
_filtered(
    "filter_free_text", PostingFilter(search="the"),
    "title ILIKE '%the%' OR company ILIKE '%the%' OR description ILIKE '%the%'", described=True,
)
_filtered("filter_reposted", PostingFilter(is_reposted=True), "is_reposted = true")
_filtered(
    "filter_combined", PostingFilter(source="src1", work_type="hybrid", saved=False, seniority="urgent"),
    "source ILIKE '%src1%' AND work_type ILIKE '%hybrid%' AND saved = false AND seniority ILIKE '%urgent%'",
)


@query("filter_any_skill", SKILLED + """ SELECT id, url FROM postings
 WHERE list_has_any(list_concat(skills_required, skills_nice_to_have), ['ring', 'PROMO'])""")
def filter_any_skill(spark, sf):
    return derived.postings(spark, sf, skills=True).where(filters.has_any_skill(["ring", "PROMO"])).select("id", "url")


@query("filter_has_salary", PLAIN + " SELECT id, salary_min, salary_max FROM postings WHERE salary_min IS NOT NULL OR salary_max IS NOT NULL")
def filter_has_salary(spark, sf):
    return derived.postings(spark, sf).where(filters.has_salary()).select("id", "salary_min", "salary_max")


@query("missing_description_by_source", DESCRIBED + """ SELECT source, CAST(count(*) AS BIGINT) AS missing FROM postings
 WHERE trim(coalesce(description, '')) = '' GROUP BY source""")
def missing_description_by_source(spark, sf):
    p = filters.missing_description(derived.postings(spark, sf, described=True))
    return p.groupBy("source").agg(F.count(F.lit(1)).alias("missing"))


@query("find_by_url", PLAIN + """, wanted AS (SELECT DISTINCT CASE WHEN id%2=0 THEN url ELSE replace(url, 'https://', '') || '/' END AS wanted_url FROM postings WHERE saved)
 SELECT wanted_url, min(CAST(regexp_extract(wanted_url, '([0-9]+)/?$', 1) AS BIGINT)) AS id, bool_or(wanted_url LIKE 'https%') AS exact FROM wanted
 WHERE wanted_url LIKE 'https%' GROUP BY wanted_url
 UNION ALL SELECT wanted_url, min(p.id), false FROM (SELECT * FROM wanted WHERE wanted_url NOT LIKE 'https%') JOIN postings p
 ON contains(p.url, rtrim(wanted_url, '/')) GROUP BY wanted_url""")
def find_by_url(spark, sf):
    p = derived.postings(spark, sf)
    wanted = p.where("saved").select(
        F.when(F.col("id") % 2 == 0, F.col("url")).otherwise(F.concat(F.regexp_replace("url", "^https://", ""), F.lit("/"))).alias("wanted_url")
    ).distinct()
    return filters.find_by_url(p, wanted)


_PARTS = """, asked AS (SELECT unnest(['job/1', '7', '/', 'src1', 'SRC2.example/JOB/3', 'src_.example/job/1', 'job/%9', 'h%s://src0', '%', '', '____', 'a_b%c', 'nowhere', 'xyz', '.example/job/', 'b/12']) AS wanted_url)"""


@query("find_by_part_of_url", PLAIN + _PARTS + """ SELECT wanted_url, min(id) AS id, false AS exact FROM asked JOIN postings ON url ILIKE '%' || rtrim(wanted_url, '/') || '%' GROUP BY wanted_url""")
def find_by_part_of_url(spark, sf):
    """Short parts, wildcards, and parts that no URL has."""
    parts = ["job/1", "7", "/", "src1", "SRC2.example/JOB/3", "src_.example/job/1", "job/%9", "h%s://src0", "%", "", "____", "a_b%c", "nowhere", "xyz", ".example/job/", "b/12"]
    asked = spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in parts])).alias("wanted_url"))
    return filters.find_by_url(derived.postings(spark, sf), asked)


# --- duplicates -------------------------------------------------------------------

@query("newest_per_key", PLAIN + """ SELECT id, company, title FROM (SELECT *, row_number() OVER (PARTITION BY company, lower(title)
 ORDER BY created_at DESC NULLS FIRST, id) AS rn FROM postings) WHERE rn = 1""")
def newest_per_key(spark, sf):
    return dedup.newest_per_key(derived.postings(spark, sf)).select("id", "company", "title")


@query("newest_per_key_after_filter", PLAIN + """ SELECT id, company, title FROM (SELECT *, row_number() OVER (PARTITION BY company, lower(title)
 ORDER BY created_at DESC NULLS FIRST, id) AS rn FROM postings WHERE status = 'O') WHERE rn = 1""")
def newest_per_key_after_filter(spark, sf):
    return listing.select_postings(derived.postings(spark, sf), PostingFilter(status="O"), True).select("id", "company", "title")


@query("dup_count_per_key", PLAIN + """ SELECT company, lower(title) AS title_l, CAST(count(*) AS BIGINT) AS dup_count
 FROM postings GROUP BY company, lower(title)""")
def dup_count_per_key(spark, sf):
    return dedup.dup_counts(derived.postings(spark, sf))


@query("dup_count_attached", PLAIN + """ SELECT id, CAST(count(*) OVER (PARTITION BY company, lower(title)) AS BIGINT) AS dup_count FROM postings""")
def dup_count_attached(spark, sf):
    p = derived.postings(spark, sf)
    return dedup.attach_dup_count(p, p).select("id", "dup_count")


@query("alternate_listing_counts", PLAIN + """ SELECT p.id, p.source, CAST((SELECT count(*) FROM postings q WHERE lower(q.title)=lower(p.title)
 AND lower(q.company)=lower(p.company) AND q.id<>p.id AND q.source<>p.source) AS BIGINT) AS alternates FROM postings p""")
def alternate_listing_counts(spark, sf):
    return dedup.alternate_counts(derived.postings(spark, sf))


@query("listings_of_shared_roles", PLAIN + """ SELECT id, source, url, lower(company) AS company_l, lower(title) AS title_l, listings FROM (
 SELECT *, CAST(count(*) OVER w AS BIGINT) AS listings, min(source) OVER w AS a, max(source) OVER w AS b FROM postings
 WINDOW w AS (PARTITION BY lower(company), lower(title))) WHERE a <> b""")
def listings_of_shared_roles(spark, sf):
    return dedup.shared_roles(derived.postings(spark, sf))


@query("alternate_listings_of_requested", PLAIN + """ SELECT a.id AS job_id, b.id, b.source, b.url FROM postings a JOIN postings b
 ON lower(a.company) = lower(b.company) AND lower(a.title) = lower(b.title) AND a.id <> b.id AND a.source <> b.source WHERE a.id % 50 = 0""")
def alternate_listings_of_requested(spark, sf):
    """The list form, for every posting whose id is divisible by 50."""
    p = derived.postings(spark, sf)
    return dedup.alternate_listings(p, p.where("id % 50 = 0").select(F.col("id").alias("job_id")))


@query("first_seen_matches", PLAIN + """ SELECT query_id, position, job_id FROM (SELECT query_id, job_id, row_number() OVER (PARTITION BY query_id ORDER BY rank, job_id) AS position FROM (
 SELECT category AS query_id, id AS job_id, id AS rank, row_number() OVER (PARTITION BY category, title, company ORDER BY id) AS rn FROM postings) WHERE rn = 1)""")
def first_seen_matches(spark, sf):
    p = derived.postings(spark, sf).select(F.col("category").alias("query_id"), F.col("id").alias("job_id"), F.col("id").alias("rank"), "title", "company")
    return dedup.first_seen(p, "query_id", "rank").select("query_id", "position", "job_id")


@query("merge_keyword_and_semantic", PLAIN + """, both_legs AS (
 SELECT category AS query_id, id AS job_id, title, company, 0 AS leg, id AS rank FROM postings WHERE saved
 UNION ALL SELECT category, id, title, company, 1, id FROM postings),
 firsts AS (SELECT *, row_number() OVER (PARTITION BY query_id, title, company ORDER BY leg, rank, job_id) AS rn FROM both_legs)
 SELECT query_id, position, job_id, CAST(leg AS INTEGER) AS leg FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY leg, rank, job_id) AS position FROM firsts WHERE rn = 1)""")
def merge_keyword_and_semantic(spark, sf):
    ranked = derived.postings(spark, sf).select(
        F.col("category").alias("query_id"), F.col("id").alias("job_id"), "title", "company", F.col("id").alias("rank"), "saved"
    )
    merged = dedup.merge_keyword_semantic(ranked.where("saved").drop("saved"), ranked.drop("saved"))
    return merged.select("query_id", "position", "job_id", "leg")


# --- pages -------------------------------------------------------------------------

_DUP = "CAST((SELECT count(*) FROM postings q WHERE q.company=p.company AND lower(q.title)=lower(p.title)) AS BIGINT) AS dup_count"


@query("page_default", PLAIN + f""" SELECT id, date_added, {_DUP} FROM (SELECT * FROM postings
 ORDER BY date_added DESC NULLS FIRST, created_at DESC NULLS FIRST, id LIMIT 50) p""")
def page_default(spark, sf):
    return listing.page_postings(derived.postings(spark, sf)).select("id", "date_added", "dup_count")


@query("page_by_salary_grouped", PAID + f""" SELECT id, salary_max_pln, {_DUP} FROM (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (
 PARTITION BY company, lower(title) ORDER BY created_at DESC NULLS FIRST, id) AS rn FROM paid WHERE work_type ILIKE '%remote%') WHERE rn = 1
 ORDER BY salary_max_pln DESC NULLS LAST, created_at DESC NULLS FIRST, id LIMIT 20 OFFSET 20) p""")
def page_by_salary_grouped(spark, sf):
    p = derived.salaried(spark, sf)
    return listing.page_postings(
        p, PostingFilter(work_type="remote"), page=2, per_page=20, sort_by="salary_desc", group_duplicates=True
    ).select("id", "salary_max_pln", "dup_count")


@query("page_by_salary_ascending", PAID + """ SELECT id, salary_min_pln FROM paid
 ORDER BY salary_min_pln ASC NULLS LAST, created_at DESC NULLS FIRST, id LIMIT 200""")
def page_by_salary_ascending(spark, sf):
    return listing.page_postings(derived.salaried(spark, sf), per_page=200, sort_by="salary_asc").select("id", "salary_min_pln")


@query("deep_page", PAID + """ SELECT id, salary_min_pln FROM paid
 ORDER BY salary_min_pln ASC NULLS LAST, created_at DESC NULLS FIRST, id LIMIT 200 OFFSET 11800""")
def deep_page(spark, sf):
    """Page 60, which a directory of ranges finds."""
    return listing.page_postings(derived.salaried(spark, sf), page=60, per_page=200, sort_by="salary_asc").select("id", "salary_min_pln")


@query("page_totals", PLAIN + """ SELECT CAST(count(*) AS BIGINT) AS total, CAST(greatest(1, ceil(count(*) / 50.0)) AS BIGINT) AS pages FROM postings WHERE status = 'F'""")
def page_totals(spark, sf):
    return listing.page_summary(derived.postings(spark, sf), PostingFilter(status="F"))


@query("page_totals_grouped", PLAIN + """ SELECT CAST(count(*) AS BIGINT) AS total, CAST(greatest(1, ceil(count(*) / 50.0)) AS BIGINT) AS pages
 FROM (SELECT DISTINCT company, lower(title) FROM postings WHERE status = 'F')""")
def page_totals_grouped(spark, sf):
    return listing.page_summary(derived.postings(spark, sf), PostingFilter(status="F"), group_duplicates=True)


@query("nested_view", PAID + """ SELECT id, url, (salary_min IS NOT NULL OR salary_max IS NOT NULL) AS has_salary,
 salary_max AS salary_max_in, salary_period AS period_in, salary_min_pln AS min_pln_in,
 CAST(len(coalesce(employment_types, []::varchar[])) AS BIGINT) AS kinds, is_reposted, saved, '' AS notes FROM paid""")
def nested_view(spark, sf):
    p = derived.salaried(spark, sf).withColumn("notes", F.lit(None).cast("string"))
    v = listing.nested_view(p)
    return v.select(
        "id", "url", F.col("salary").isNotNull().alias("has_salary"), F.col("salary.max").alias("salary_max_in"),
        F.col("salary.period").alias("period_in"), F.col("salary.min_pln").alias("min_pln_in"),
        F.size("employment_types").cast("bigint").alias("kinds"), "is_reposted", "saved", "notes",
    )


@query("import_status_view", PLAIN + """ SELECT source, 'running' AS status, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (status <> 'O') AS BIGINT) AS processed,
 CAST(count(*) FILTER (status = 'F') AS BIGINT) AS imported, CAST(0 AS BIGINT) AS skipped, CAST(0 AS BIGINT) AS errors, CAST(0 AS BIGINT) AS pending,
 CAST(floor(count(*) FILTER (status <> 'O') / count(*) * 100 + 0.5) AS BIGINT) AS percent FROM postings GROUP BY source""")
def import_status_view(spark, sf):
    progress = derived.postings(spark, sf).groupBy("source").agg(
        F.lit("running").alias("status"), F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") != "O").alias("processed"),
        F.count_if(F.col("status") == "F").alias("imported"),
    )
    nothing = {c: F.lit(None).cast("bigint") for c in ("skipped", "errors")}
    lists = {c: F.lit(None).cast("array<string>") for c in ("error_log", "pending_urls")}
    return listing.import_status_view(progress.withColumns({**nothing, **lists})).drop("error_log")


# --- facets and top-k -----------------------------------------------------------------

for _column, _extra in (("category", ""), ("work_type", ""), ("seniority", " AND seniority NOT IN ('C-level')")):
    @query(f"distinct_{_column}", PLAIN + f" SELECT DISTINCT {_column} FROM postings WHERE {_column} IS NOT NULL AND {_column} <> ''{_extra}")
    def distinct_values(spark, sf, _column=_column):
        return listing.distinct_values(derived.postings(spark, sf), _column)


@query("top_locations", PLAIN + """ SELECT location, CAST(count(*) AS BIGINT) AS count FROM (SELECT unnest(location) AS location FROM postings)
 GROUP BY location ORDER BY count DESC, location LIMIT 50""")
def top_locations(spark, sf):
    return listing.top_locations(derived.postings(spark, sf))


@query("attached_detected_skills", PLAIN + """, detected AS (SELECT p_partkey AS job_id, unnest(string_split(p_name, ' ')) AS skill_name FROM part),
 found AS (SELECT DISTINCT company, lower(title) AS tl, skill_name FROM detected JOIN postings ON id = job_id),
 lists AS (SELECT company, tl, array_to_string(list_sort(list(skill_name)), '|') AS skills FROM found GROUP BY company, tl)
 SELECT p.id, coalesce(skills, '') AS detected_skills FROM postings p LEFT JOIN lists l ON l.company = p.company AND l.tl = lower(p.title)""")
def attached_detected_skills(spark, sf):
    p = derived.postings(spark, sf)
    detected = derived.table(spark, sf, "part").select(F.col("p_partkey").alias("job_id"), F.explode(F.split("p_name", " ")).alias("skill_name"))
    return listing.attach_detected_skills(p, p, detected).select("id", F.array_join("detected_skills", "|").alias("detected_skills"))
