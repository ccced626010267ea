"""Vocabulary, detection, category profiles, overlap matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobweave import fixed_values as fv
from jobweave.catalog import query
from jobweave.catalog.views import REPEATED, RESUMES, SKILLED, TEXT_POSTINGS
from jobweave.operators import detect, listing, skills
from jobweave.session import cut_lineage
from jobweave.sources import derived


@query("top_required_skills", REPEATED + """ SELECT skill, CAST(count(*) AS BIGINT) AS count FROM (SELECT unnest(skills_required) AS skill FROM postings)
 GROUP BY skill ORDER BY count DESC, skill LIMIT 10""")
def top_required_skills(spark, sf):
    return listing.top_required_skills(derived.postings(spark, sf, repeated_skills=True), 10)


_ALL_SKILLS = """, tagged AS (SELECT category, unnest(skills_required) AS skill, 1 AS req FROM postings UNION ALL SELECT category, unnest(skills_nice_to_have), 0 FROM postings),
counted AS (SELECT skill, CAST(count(*) AS BIGINT) AS count, CAST(sum(req) AS BIGINT) AS required_count, CAST(sum(1 - req) AS BIGINT) AS nice_count FROM tagged WHERE {} GROUP BY skill)"""


@query("skill_counts", REPEATED + _ALL_SKILLS.format("true") + " SELECT * FROM counted")
def skill_counts(spark, sf):
    return skills.skill_counts(derived.postings(spark, sf, repeated_skills=True))


@query("skill_counts_of_category", REPEATED + _ALL_SKILLS.format("category = 'BUILDING'") + " SELECT * FROM counted WHERE contains(lower(skill), 'r')")
def skill_counts_of_category(spark, sf):
    return skills.skill_counts(derived.postings(spark, sf, repeated_skills=True), "BUILDING", "R")


@query("skills_page", REPEATED + _ALL_SKILLS.format("true") + """, page AS (SELECT *, row_number() OVER (ORDER BY count DESC, skill) AS rank FROM counted QUALIFY rank BETWEEN 6 AND 10)
 SELECT skill, count, required_count, CAST(rank AS BIGINT) AS rank, CAST(floor(count / max(count) OVER () * 100 + 0.5) AS BIGINT) AS share,
 CAST(floor(required_count / max(count) OVER () * 100 + 0.5) AS BIGINT) AS required_share FROM page""")
def skills_page(spark, sf):
    return skills.skills_page(derived.postings(spark, sf, repeated_skills=True), page=2, per_page=5)


@query("skills_totals", REPEATED + _ALL_SKILLS.format("category = 'BUILDING'") + """ SELECT (SELECT CAST(count(*) AS BIGINT) FROM postings WHERE category = 'BUILDING') AS total_jobs,
 CAST(count(*) AS BIGINT) AS total_skills, CAST(greatest(1, ceil(count(*) / 5.0)) AS BIGINT) AS pages FROM counted""")
def skills_totals(spark, sf):
    return skills.skills_totals(derived.postings(spark, sf, repeated_skills=True), per_page=5, category="BUILDING")


@query("top_nice_to_have_skills", REPEATED + """ SELECT skill, CAST(count(*) AS BIGINT) AS count FROM (SELECT unnest(skills_nice_to_have) AS skill FROM postings)
 GROUP BY skill ORDER BY count DESC, skill LIMIT 3""")
def top_nice_to_have_skills(spark, sf):
    return skills.top_listed_skills(derived.postings(spark, sf, repeated_skills=True), "skills_nice_to_have", 3)


@query("known_skills", TEXT_POSTINGS + " SELECT skill FROM known")
def known_skills(spark, sf):
    return skills.known_skills(derived.text_postings(spark, sf))


@query("known_skills_of_orders", SKILLED + """ SELECT DISTINCT skill FROM (SELECT unnest(skills_required) AS skill FROM postings UNION ALL SELECT unnest(skills_nice_to_have) FROM postings)""")
def known_skills_of_orders(spark, sf):
    return skills.known_skills(derived.postings(spark, sf, skills=True))


# --- detection ------------------------------------------------------------------------

# Terms without a delimiter are looked up among the pieces of a text, the others by search.
_EDGE = r"[\s,;()\[\]/|.]"
_FOUND = TEXT_POSTINGS + f""",
terms AS (SELECT skill, lower(skill) AS t, regexp_matches(skill, '{_EDGE}') AS multi FROM known),
texts AS (SELECT id, 'title' AS field, lower(title) AS t FROM tp UNION ALL SELECT id, 'description', lower(description) FROM tp),
pieces AS (SELECT DISTINCT id, field, piece FROM (SELECT id, field, unnest(regexp_split_to_array(t, '{_EDGE}')) AS piece FROM texts)),
found AS (SELECT id, field, skill FROM pieces JOIN terms ON NOT multi AND piece = terms.t
 UNION ALL SELECT id, field, skill FROM texts JOIN terms ON multi AND contains(texts.t, terms.t)
 WHERE regexp_matches(texts.t, '(?:^|{_EDGE})' || regexp_escape(terms.t) || '(?:{_EDGE}|$)'))"""
_DETECTED = _FOUND + """,
detected AS (SELECT f.id AS job_id, f.skill AS skill_name, max(field) AS source_field FROM found f JOIN tp ON tp.id = f.id
 WHERE NOT list_contains(list_transform(list_concat(skills_required, skills_nice_to_have), lambda s: lower(s)), lower(f.skill)) GROUP BY 1, 2)"""


@query("terms_in_documents", _FOUND + " SELECT id, skill AS term FROM found WHERE field = 'description'")
def terms_in_documents(spark, sf):
    p = derived.text_postings(spark, sf)
    return detect.detect_terms(p, skills.known_skills(p), text="description")


@query("detected_skills", _DETECTED + " SELECT job_id, skill_name, source_field FROM detected")
def detected_skills(spark, sf):
    p = derived.text_postings(spark, sf)
    return detect.detect_skills(p, skills.known_skills(p))


_PROCESSED = "SELECT doc_id AS job_id FROM labels"


@query("detected_in_unprocessed", _DETECTED + f" SELECT job_id, skill_name, source_field FROM detected WHERE job_id NOT IN ({_PROCESSED})")
def detected_in_unprocessed(spark, sf):
    p = derived.text_postings(spark, sf)
    processed = derived.table(spark, sf, "labels").select(F.col("doc_id").alias("job_id"))
    return detect.detect_missing(p, processed, skills.known_skills(p))


@query("postings_without_detection", TEXT_POSTINGS + f" SELECT id FROM tp WHERE id NOT IN ({_PROCESSED})")
def postings_without_detection(spark, sf):
    processed = derived.table(spark, sf, "labels").select(F.col("doc_id").alias("job_id"))
    return detect.undetected(derived.text_postings(spark, sf), processed).select("id")


@query("detected_rows_to_append", TEXT_POSTINGS + f""", found AS (SELECT id AS job_id, unnest(skills_required) AS skill_name FROM tp)
 SELECT DISTINCT job_id, skill_name FROM found WHERE job_id NOT IN ({_PROCESSED})""")
def detected_rows_to_append(spark, sf):
    p = derived.text_postings(spark, sf)
    found = p.select(F.col("id").alias("job_id"), F.explode("skills_required").alias("skill_name"))
    stored = found.join(derived.table(spark, sf, "labels").select(F.col("doc_id").alias("job_id")), "job_id", "left_semi")
    return detect.upsert_detected(stored, found)


@query("detected_skills_of_jobs", TEXT_POSTINGS + f""" SELECT DISTINCT id AS job_id, unnest(skills_required) AS skill_name, 'title' AS source_field FROM tp WHERE id IN ({_PROCESSED})""")
def detected_skills_of_jobs(spark, sf):
    p = derived.text_postings(spark, sf)
    stored = p.select(F.col("id").alias("job_id"), F.explode("skills_required").alias("skill_name"), F.lit("title").alias("source_field")).distinct()
    return detect.detected_of(stored, derived.table(spark, sf, "labels").select(F.col("doc_id").alias("job_id")).distinct())


_KEYWORDS = _FOUND + f""",
keywords AS (SELECT id AS resume_id, unnest(list_filter(list_transform(regexp_extract_all(description, '[a-zA-Z0-9]+(?:-[a-zA-Z0-9]+)*'), lambda t: lower(t)),
 lambda t: length(t) >= 2 AND t NOT IN ({', '.join(f"'{w}'" for w in fv.STOPWORDS)}))) AS keyword FROM tp UNION SELECT id, skill FROM found WHERE field = 'description')"""


def _known(spark, sf):
    """The known skills, which several steps read, from one reading of the texts."""
    return cut_lineage(skills.known_skills(derived.text_postings(spark, sf)))


def _keywords(spark, sf, known=None):
    p = derived.text_postings(spark, sf)
    texts = p.select(F.col("id").alias("resume_id"), F.col("description").alias("text"))
    return detect.keywords(texts, _known(spark, sf) if known is None else known)


@query("resume_keywords", _KEYWORDS + " SELECT DISTINCT resume_id, keyword FROM keywords")
def resume_keywords(spark, sf):
    return _keywords(spark, sf)


@query("resume_keywords_with_model", _KEYWORDS + """ SELECT DISTINCT resume_id, keyword FROM keywords UNION
 SELECT DISTINCT doc_id, 'term ' || source FROM documents""")
def resume_keywords_with_model(spark, sf):
    """Keywords found by rule together with those another model names."""
    named = derived.table(spark, sf, "documents").select(F.col("doc_id").alias("resume_id"), F.concat(F.lit("term "), "source").alias("keyword"))
    return skills.with_extra_keywords(_keywords(spark, sf), named)


@query("resume_skills_canonical", _KEYWORDS + f""", vocabulary AS (SELECT lower(skill) AS k, max(skill) AS canonical FROM known GROUP BY 1),
 tagged AS (SELECT resume_id, keyword, canonical FROM keywords LEFT JOIN vocabulary ON k = lower(keyword)),
 none AS (SELECT resume_id FROM tagged GROUP BY 1 HAVING count(canonical) = 0)
 SELECT DISTINCT resume_id, canonical AS skill FROM tagged WHERE canonical IS NOT NULL
 UNION ALL SELECT DISTINCT resume_id, keyword FROM keywords WHERE resume_id IN (SELECT resume_id FROM none) AND length(keyword) >= 2""")
def resume_skills_canonical(spark, sf):
    known = _known(spark, sf)
    return skills.canonical_resume_skills(_keywords(spark, sf, known), known)


# --- profiles and matching ----------------------------------------------------------------

_PROFILE = SKILLED + ", " + RESUMES + """,
jobs AS (SELECT category, count(*) AS job_count FROM postings GROUP BY category),
weights AS (SELECT category, lower(trim(skill)) AS skill_n, min(skill) AS display, count(*) AS weight, max(req) = 1 AS required FROM (
 SELECT category, unnest(skills_required) AS skill, 1 AS req FROM postings UNION ALL SELECT category, unnest(skills_nice_to_have), 0 FROM postings) GROUP BY 1, 2),
totals AS (SELECT category, sum(weight) AS total_weight FROM weights GROUP BY category),
mine AS (SELECT DISTINCT resume_id, lower(trim(skill)) AS skill_n FROM resumes)"""


@query("category_skill_profile", _PROFILE + """ SELECT category, job_count, CAST(total_weight AS BIGINT) AS total_weight, skill_n, display, CAST(weight AS BIGINT) AS weight, required
 FROM jobs JOIN totals USING (category) JOIN weights USING (category)""")
def category_skill_profile(spark, sf):
    return skills.category_skills(derived.postings(spark, sf, skills=True))


_SCORES = _PROFILE + """,
matched AS (SELECT resume_id, category, sum(weight) AS mw, array_to_string(list(display || ':' || weight ORDER BY weight DESC, display), '|') AS matching FROM mine JOIN weights USING (skill_n) GROUP BY 1, 2),
scores AS (SELECT m.resume_id, j.category, j.job_count, CAST(round_even(mw / total_weight * 100, 0) AS BIGINT) AS match_score, matching AS matching_skills
 FROM matched m JOIN jobs j USING (category) JOIN totals t USING (category))"""


def _scores(spark, sf):
    return skills.category_scores(derived.postings(spark, sf, skills=True), derived.resumes(spark, sf))


@query("category_match_scores", _SCORES + " SELECT * FROM scores")
def category_match_scores(spark, sf):
    shown = F.array_join(F.transform("matching_skills", lambda e: F.concat_ws(":", e["skill"], e["weight"].cast("string"))), "|")
    return _scores(spark, sf).withColumn("matching_skills", shown)


@query("top_matching_categories", _SCORES + """ SELECT resume_id, category, match_score, position FROM (SELECT *, row_number() OVER (PARTITION BY resume_id ORDER BY match_score DESC, category) AS position
 FROM scores) WHERE position <= 3""")
def top_matching_categories(spark, sf):
    return skills.top_categories(_scores(spark, sf), 3).select("resume_id", "category", "match_score", "position")


_TO_ADD = _PROFILE + """ SELECT resume_id, category, position, skill, CAST(weight AS BIGINT) AS weight FROM (SELECT resume_id, w.category, display AS skill, weight,
 row_number() OVER (PARTITION BY resume_id, w.category ORDER BY weight DESC, display, w.skill_n) AS position FROM (SELECT DISTINCT resume_id, category FROM mine JOIN weights USING (skill_n)) r
 JOIN weights w USING (category) WHERE {} NOT EXISTS (SELECT 1 FROM mine m WHERE m.resume_id = r.resume_id AND m.skill_n = w.skill_n)) {}"""


@query("skills_to_add", _TO_ADD.format("weight >= 5 AND", "WHERE position <= 6"))
def skills_to_add(spark, sf):
    return skills.skills_to_add(derived.postings(spark, sf, skills=True), derived.resumes(spark, sf), limit=6, min_weight=5)


@query("all_skills_to_add", _TO_ADD.format("", ""))
def all_skills_to_add(spark, sf):
    return skills.skills_to_add(derived.postings(spark, sf, skills=True), derived.resumes(spark, sf))


@query("category_scores_of_pairs", _SCORES + """ SELECT c.c_custkey AS resume_id, c.c_mktsegment || CASE WHEN c_custkey % 2 = 0 THEN '' ELSE ' elsewhere' END AS category, coalesce(match_score, 0) AS match_score
 FROM customer c LEFT JOIN scores s ON s.resume_id = c_custkey AND s.category = c.c_mktsegment || CASE WHEN c_custkey % 2 = 0 THEN '' ELSE ' elsewhere' END""")
def category_scores_of_pairs(spark, sf):
    """The score of every customer's resume in the customer's own segment, which for half of them is none of the postings'."""
    k = F.col("c_custkey")
    asked = derived.table(spark, sf, "customer").select(
        k.alias("resume_id"), F.concat("c_mktsegment", F.when(k % 2 == 0, "").otherwise(" elsewhere")).alias("category"))
    return skills.scores_of(asked, _scores(spark, sf))


@query("match_score_from_lists", SKILLED + """ SELECT id, CAST(CASE WHEN len(skills_required) + len(skills_nice_to_have) > 0 THEN floor(len(skills_required) * 3 / (len(skills_required) * 3 + len(skills_nice_to_have)) * 100 + 0.5)
 ELSE 0 END AS BIGINT) AS match_score FROM postings""")
def match_score_from_lists(spark, sf):
    p = derived.postings(spark, sf, skills=True)
    weighted = lambda c, w: F.transform(c, lambda s: F.struct(s.alias("skill"), F.lit(w).cast("bigint").alias("weight")))
    return p.select("id", skills.score_from_lists(weighted("skills_required", 3), weighted("skills_nice_to_have", 1)).alias("match_score"))


_OVERLAP = SKILLED + ", " + RESUMES + """,
mine AS (SELECT DISTINCT resume_id, lower(trim(skill)) AS s FROM resumes), sizes AS (SELECT resume_id, count(*) AS n FROM mine GROUP BY 1),
raws AS (SELECT id, unnest(skills_required) AS raw, 1 AS kind FROM postings UNION ALL SELECT id, unnest(skills_nice_to_have), 2 FROM postings),
listed AS (SELECT id, lower(trim(raw)) AS s, arg_max(raw, kind) AS raw FROM raws GROUP BY 1, 2),
pairs AS (SELECT resume_id, id AS job_id, count(*) AS c, array_to_string(list_sort(list(raw)), '|') AS shown FROM mine JOIN listed USING (s) GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY resume_id ORDER BY c DESC, job_id) AS rank FROM pairs)"""
_OVERLAP_ROWS = " SELECT resume_id, rank, job_id, CAST(c AS BIGINT) AS match_count, round(c / n, 6) AS match_ratio{} FROM ranked JOIN sizes USING (resume_id) WHERE rank <= {}"


@query("matched_postings", _OVERLAP + _OVERLAP_ROWS.format(", shown AS matched_skills", 100))
def matched_postings(spark, sf):
    m = skills.match_postings(derived.postings(spark, sf, skills=True), derived.resumes(spark, sf), 100)
    return m.withColumns({"match_ratio": F.round("match_ratio", 6), "matched_skills": F.array_join("matched_skills", "|")})


@query("matched_postings_of_list", _OVERLAP.replace("lower(trim(raw))", "lower(raw)").replace("list_sort(list(raw))", "list_sort(list(s))") + _OVERLAP_ROWS.format(", shown AS matched_skills", 20))
def matched_postings_of_list(spark, sf):
    m = skills.match_postings(derived.postings(spark, sf, skills=True), derived.resumes(spark, sf), limit=20, trim=False)
    return m.withColumns({"match_ratio": F.round("match_ratio", 6), "matched_skills": F.array_join("matched_skills", "|")})


@query("matched_postings_exact_case", _OVERLAP.replace("ranked AS (SELECT *,", """exact AS (SELECT DISTINCT resume_id, id AS job_id FROM resumes JOIN raws ON raw = skill),
ranked AS (SELECT pairs.*,""").replace("FROM pairs)", "FROM pairs SEMI JOIN exact USING (resume_id, job_id))") + _OVERLAP_ROWS.format("", 20))
def matched_postings_exact_case(spark, sf):
    m = skills.match_postings_exact_case(derived.postings(spark, sf, skills=True), derived.resumes(spark, sf), limit=20)
    return m.withColumn("match_ratio", F.round("match_ratio", 6))


@query("skill_set_operations", _OVERLAP.replace("ranked AS", "ranked0 AS") + """ SELECT resume_id, CAST(count(*) AS BIGINT) AS jobs, CAST(sum(c) AS BIGINT) AS matched, CAST(sum(l.n - c) AS BIGINT) AS missing
 FROM pairs JOIN (SELECT id AS job_id, count(DISTINCT s) AS n FROM listed GROUP BY 1) l USING (job_id) WHERE job_id = resume_id GROUP BY 1""")
def skill_set_operations(spark, sf):
    """Skills shared by a resume and the posting with its number, and those it lacks."""
    r = derived.resumes(spark, sf)
    pairs = r.select("resume_id", F.col("resume_id").alias("job_id")).distinct()
    d = skills.skill_differences(derived.postings(spark, sf, skills=True), r, pairs).where(F.size("common") > 0)
    return d.groupBy("resume_id").agg(
        F.count(F.lit(1)).alias("jobs"), F.sum(F.size("common")).alias("matched"), F.sum(F.size("missing")).alias("missing")
    )
