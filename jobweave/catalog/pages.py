"""Postings out of JSON feeds and web pages.

Feeds and offer pages are written by Spark from the posting tables and read back, so the
twin states the expected fields straight from the columns.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from jobweave import fixed_values as fv
from jobweave.catalog import query
from jobweave.catalog.views import SKILLED
from jobweave.sources import board_feed, derived, pages


@query("page_headings", r"""SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]+>', '', 'g')) AS title,
 CAST(len(regexp_extract_all(html, '(?i)<a\s[^>]*href="([^"]*)"', 1)) AS BIGINT) AS links FROM pages""")
def page_headings(spark, sf):
    return derived.table(spark, sf, "pages").select(
        "page_id", pages.heading_text(F.col("html")).alias("title"), F.size(pages.link_targets(F.col("html"))).cast("bigint").alias("links")
    )


@query("harvested_links", r"""WITH l AS (SELECT page_id, regexp_extract_all(html, '<a href="/([a-z]+)"', 1) AS slugs FROM pages),
 u AS (SELECT page_id, unnest(slugs) AS slug, unnest(range(len(slugs))) AS pos FROM l),
 r AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY page_id, pos) AS rn FROM u)
 SELECT 'https://x.example/' || slug AS url, page_id AS page_no, CAST(pos AS BIGINT) AS position FROM r WHERE rn = 1""")
def harvested_links(spark, sf):
    return pages.harvest_links(derived.table(spark, sf, "pages"), '<a href="/([a-z]+)"', "https://x.example/")


@query("routed_pages", """SELECT page_id, CASE WHEN url LIKE '%example.com%' THEN 'example.com' WHEN url LIKE '%example.net%' THEN 'example.net' END AS board,
 CASE WHEN url NOT LIKE '%example.com%' AND url NOT LIKE '%example.net%' THEN 'Unsupported URL: ' || url || '. Supported sites: example.com, example.net' END AS error FROM pages""")
def routed_pages(spark, sf):
    good, bad = pages.route_by_source(derived.table(spark, sf, "pages"), ["example.com", "example.net"])
    return good.withColumn("error", F.lit(None).cast("string")).unionByName(
        bad.withColumn("board", F.lit(None).cast("string"))
    ).select("page_id", "board", "error")


# --- JSON feed ------------------------------------------------------------------------------

def feed_lines(spark, sf):
    """One JSON line per posting, as the board sends it; every 50th line is cut short."""
    p = derived.postings(spark, sf, skills=True)
    k = F.col("id")
    tile = lambda kind: (lambda s: F.struct(F.lit(kind).alias("type"), s.alias("value")))
    extra = F.array(F.struct(F.lit("requirement").alias("type"), F.lit("x" * 60).alias("value")), F.struct(F.lit("other").alias("type"), F.lit("y").alias("value")))
    body = F.to_json(F.struct(
        F.concat(F.lit("offer-"), k).alias("url"), F.col("title"), F.col("company").alias("name"),
        F.when(k % 2 == 0, F.col("category")).alias("category"),
        F.struct(
            F.transform(F.concat("location", F.slice("location", 1, 1)), lambda c: F.struct(c.alias("city"))).alias("places"),
            (F.col("work_type") == "Remote").alias("fullyRemote"), F.when(F.col("work_type") == "Hybrid", "2 days").alias("hybridDesc"),
        ).alias("location"),
        F.when(F.col("salary_min").isNotNull(), F.struct(
            F.col("salary_min").alias("from"), F.col("salary_max").alias("to"), F.lower("salary_currency").alias("currency"),
            F.when(k % 3 == 0, "b2b").when(k % 3 == 1, "permanent").otherwise("other").alias("type"),
        )).alias("salary"),
        F.struct(F.concat(
            F.transform("skills_required", tile("requirement")), F.transform("skills_required", tile("requirement")),
            F.transform("skills_nice_to_have", tile("niceToHave")), extra,
        ).alias("values")).alias("tiles"),
        F.array(F.lower("seniority")).alias("seniority"), (F.unix_date(F.col("created_at").cast("date")).cast("bigint") * 86_400_000).alias("posted"),
        F.lit("").alias("description"), F.concat(F.lit("About "), "title").alias("offerDescription"),
    ))
    # An object category, spliced in where the string one was left out.
    named = F.regexp_replace(body, r"^\{", F.concat(F.lit('{"category":{"id":"'), F.lower("category"), F.lit('"},')))
    line = F.when(k % 2 == 0, body).otherwise(named)
    return p.select("id", F.explode(F.array(F.when(k % 50 == 49, F.substring(line, 1, 40)).otherwise(line))).alias("line"))


@query("parsed_feed", SKILLED + """ SELECT 'https://nofluffjobs.com/pl/job/offer-' || id AS url, title, company, array_to_string(location, '|') AS location, salary_min,
 CASE WHEN salary_min IS NOT NULL THEN salary_max END AS salary_max, CASE WHEN salary_min IS NOT NULL THEN salary_currency END AS salary_currency,
 CASE WHEN salary_min IS NOT NULL THEN CASE id%3 WHEN 0 THEN 'B2B' WHEN 1 THEN 'Permanent' ELSE 'OTHER' END END AS salary_type,
 array_to_string(skills_required, '|') AS skills_required, array_to_string(skills_nice_to_have, '|') AS skills_nice_to_have, upper(seniority[1]) || lower(seniority[2:]) AS seniority,
 CASE WHEN work_type IN ('Remote', 'Hybrid') THEN work_type END AS work_type, 'About ' || title AS description, upper(category[1]) || lower(category[2:]) AS category, date_added AS date_published
 FROM postings WHERE id%50 <> 49""")
def parsed_feed(spark, sf):
    good, _ = board_feed.parse_feed(feed_lines(spark, sf))
    text = lambda c: F.array_join(c, "|").alias(c)
    return good.select(
        "url", "title", "company", text("location"), "salary_min", "salary_max", "salary_currency", "salary_type", text("skills_required"),
        text("skills_nice_to_have"), "seniority", "work_type", "description", "category", "date_published",
    )


@query("rejected_feed_lines", SKILLED + " SELECT CAST(count(*) AS BIGINT) AS lines, 'unreadable JSON' AS error FROM postings WHERE id%50 = 49")
def rejected_feed_lines(spark, sf):
    _, bad = board_feed.parse_feed(feed_lines(spark, sf))
    return bad.groupBy("error").agg(F.count(F.lit(1)).alias("lines"))


@query("dropped_feed_skills", SKILLED + " SELECT 'https://nofluffjobs.com/pl/job/offer-' || id AS url, repeat('x', 60) AS skill FROM postings WHERE id%50 <> 49")
def dropped_feed_skills(spark, sf):
    good, _ = board_feed.parse_feed(feed_lines(spark, sf))
    return good.select("url", F.explode("dropped_skills").alias("skill"))


# --- offer pages ----------------------------------------------------------------------------

def _json_ld(k):
    names = F.transform("skills_required", lambda s: F.struct(s.alias("name")))
    ld = F.to_json(F.struct(
        F.lit("JobPosting").alias("@type"), "title", F.concat(F.lit("Work on "), "category").alias("description"),
        F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss").alias("datePosted"),
        F.when(k % 2 == 0, "TELECOMMUTE").alias("jobLocationType"),
        F.struct(F.col("company").alias("name")).alias("hiringOrganization"),
        F.struct(F.struct(F.col("location")[0].alias("addressLocality")).alias("address")).alias("jobLocation"),
        F.when(F.col("salary_min").isNotNull(), F.struct(
            F.col("salary_currency").alias("currency"), F.struct(F.col("salary_min").alias("minValue"), F.col("salary_max").alias("maxValue")).alias("value")
        )).alias("baseSalary"),
        F.when(k % 3 == 0, F.array_join("skills_required", ", ")).alias("skills"),
    ))
    listed = F.when(k % 3 == 1, F.to_json("skills_required")).otherwise(F.to_json(names))
    return F.when(k % 3 == 0, ld).otherwise(F.concat(F.regexp_replace(ld, r"\}$", ""), F.lit(',"skills":'), listed, F.lit("}")))


def _payload_json(k):
    pay = F.when(F.col("salary_min").isNotNull(), F.array(
        F.struct(F.lit(1.0).alias("from"), F.lit(2.0).alias("to"), F.lit("eur").alias("currency"), F.lit("permanent").alias("type"), F.lit(True).alias("gross"), F.lit("Month").alias("timeUnit")),
        F.struct(F.col("salary_min").alias("from"), F.col("salary_max").alias("to"), F.lower("salary_currency").alias("currency"), F.lit("b2b").alias("type"),
                 F.lit(False).alias("gross"), F.when(k % 6 == 0, "Hour").otherwise("Month").alias("timeUnit")),
    ))
    skill = lambda level: (lambda s: F.struct(s.alias("name"), F.lit(level).alias("level")))
    return F.to_json(F.struct(
        F.concat(F.lit("offer-"), k).alias("slug"), "title", F.struct(F.lower("seniority").alias("label")).alias("experienceLevel"),
        F.col("company").alias("companyName"), F.coalesce("work_type", F.lit("")).alias("workplaceType"),
        F.transform("location", lambda c: F.struct(c.alias("city"))).alias("multilocation"),
        F.concat(F.transform("skills_required", skill(4)), F.transform("skills_nice_to_have", skill(1))).alias("requiredSkills"),
        F.lower("category").alias("category"), F.lit("a {nested} body").alias("body"), F.lit("2024-05-06T07:08:09Z").alias("publishedAt"),
        pay.alias("employmentTypes"),
    ))


def offer_url():
    """Address of a posting's page."""
    kind, path = F.col("id") % 5, F.concat(F.lit("/job-offer/offer-"), "id", F.lit("-devops"))
    return F.when(kind < 3, F.concat(F.lit("https://justjoin.it"), path)).when(
        kind == 3, F.concat(F.lit("https://nofluffjobs.com/pl/backend"), path)).otherwise(F.concat(F.lit("https://elsewhere.example"), path))


def offer_pages(spark, sf):
    """One page per posting: embedded payload, structured data, plain tags of two boards, or
    an address no board owns."""
    return pages_of(derived.postings(spark, sf, skills=True))


def pages_of(p):
    """The pages of ``p``, postings with skills."""
    k = F.col("id")
    items = lambda c: F.concat(F.lit("<ul>"), F.array_join(F.transform(c, lambda s: F.concat(F.lit("<li> "), s, F.lit(" </li>"))), ""), F.lit("</ul>"))
    payload = F.concat(F.lit('<html><script>self.__next_f.push([1,"x"])//'), _payload_json(k), F.lit("</script></html>"))
    ld = F.concat(
        F.lit('<html><script type="application/ld+json">{"@type":"Other"}</script><script type="application/ld+json">'), _json_ld(k),
        F.lit("</script><body><p>Senior role, B2B</p></body></html>"),
    )
    plain = F.concat(
        F.lit("<html><body><h1> "), "title", F.lit(' </h1><a href="/company/x">'), "company", F.lit("</a><h3>Must have</h3>"), items("skills_required"),
        F.lit("<h3>Nice to have</h3>"), items("skills_nice_to_have"), F.lit('<meta name="description" content=" Short "></body></html>'),
    )
    nf = F.concat(
        F.lit("<html><body><section><h1>"), "title", F.lit("</h1><p>"), "company", F.lit("</p><h2>Obowiązkowe</h2>"), items("skills_required"),
        F.lit("<h2>Mile widziane</h2>"), items("skills_nice_to_have"), F.lit("<h2>Opis</h2><p>Praca zdalnie<br>w Kraków</p><p>10 000 – 12 000 PLN, B2B, ważna do 03.04.2025</p></section></body></html>"),
    )
    kind = k % 5
    return p.select(
        "id", offer_url().alias("url"),
        F.explode(F.array(F.when(kind == 0, payload).when(kind == 1, ld).when(kind == 2, plain).otherwise(nf))).alias("html"),
    )


_TITLE = "upper({0}[1]) || lower({0}[2:])"
_PAGE_SQL = SKILLED + f""", expected AS (SELECT *, id%5 AS kind, array_to_string(skills_required, '|') AS req, array_to_string(skills_nice_to_have, '|') AS nice,
 CASE WHEN id%5 < 3 THEN 'https://justjoin.it' WHEN id%5 = 3 THEN 'https://nofluffjobs.com/pl/backend' ELSE 'https://elsewhere.example' END || '/job-offer/offer-' || id || '-devops' AS page_url FROM postings)"""


@query("parsed_pages", _PAGE_SQL + f""" SELECT page_url AS url, CASE WHEN kind = 3 THEN 'nofluffjobs.com' ELSE 'justjoin.it' END AS source, title, company,
 CASE kind WHEN 0 THEN array_to_string(location, '|') WHEN 1 THEN location[1] WHEN 2 THEN '' ELSE 'Kraków' END AS location,
 CASE kind WHEN 0 THEN CASE WHEN salary_currency IN ('PLN', 'USD', 'EUR') THEN salary_min WHEN salary_min IS NOT NULL THEN 1.0 END WHEN 1 THEN salary_min WHEN 3 THEN 10000.0 END AS salary_min,
 CASE kind WHEN 0 THEN CASE WHEN salary_min IS NULL THEN NULL WHEN salary_currency IN ('PLN', 'USD', 'EUR') THEN salary_currency ELSE 'EUR' END WHEN 1 THEN CASE WHEN salary_min IS NOT NULL THEN salary_currency END WHEN 3 THEN 'PLN' END AS salary_currency,
 CASE kind WHEN 0 THEN CASE WHEN salary_min IS NULL THEN NULL WHEN salary_currency IN ('PLN', 'USD', 'EUR') THEN 'B2B' ELSE 'PERMANENT' END WHEN 1 THEN CASE WHEN salary_min IS NOT NULL THEN 'B2B' END WHEN 3 THEN 'B2B' END AS salary_type,
 CASE WHEN kind = 0 AND salary_min IS NOT NULL THEN CASE WHEN id%6 = 0 AND salary_currency IN ('PLN', 'USD', 'EUR') THEN 'hourly' ELSE 'monthly' END END AS explicit_period,
 req AS skills_required, CASE kind WHEN 1 THEN '' ELSE nice END AS skills_nice_to_have,
 CASE kind WHEN 0 THEN {_TITLE.format('seniority')} WHEN 1 THEN 'Senior' END AS seniority,
 CASE kind WHEN 0 THEN work_type WHEN 1 THEN CASE WHEN id%2 = 0 THEN 'Remote' END WHEN 3 THEN 'Remote' END AS work_type,
 CASE kind WHEN 0 THEN CASE WHEN salary_min IS NOT NULL THEN 'permanent|b2b' ELSE '' END WHEN 2 THEN '' ELSE 'B2B' END AS employment_types,
 CASE kind WHEN 0 THEN 'a {{nested}} body' WHEN 1 THEN 'Work on ' || category WHEN 2 THEN 'Short' ELSE 'Praca zdalnie' || chr(10) || 'w Kraków' || chr(10) || chr(10) || '10 000 – 12 000 PLN, B2B, ważna do 03.04.2025' END AS description,
 CASE kind WHEN 0 THEN {_TITLE.format('category')} WHEN 3 THEN 'Backend' ELSE 'DevOps' END AS category,
 CASE kind WHEN 0 THEN '2024-05-06' WHEN 1 THEN date_added END AS date_published, CASE kind WHEN 3 THEN '2025-04-03' END AS date_expires
 FROM expected WHERE kind < 4""")
def parsed_pages(spark, sf):
    parsed, _ = pages.parse_pages(offer_pages(spark, sf))
    text = lambda c: F.array_join(c, "|").alias(c)
    return parsed.select(
        "url", "source", "title", "company", text("location"), "salary_min", "salary_currency", "salary_type", "explicit_period",
        text("skills_required"), text("skills_nice_to_have"), "seniority", "work_type", text("employment_types"), "description", "category",
        "date_published", "date_expires",
    )


@query("unsupported_pages", _PAGE_SQL + """ SELECT page_url AS url, 'Unsupported URL: ' || page_url || '. Supported sites: justjoin.it, nofluffjobs.com' AS error FROM expected WHERE kind = 4""")
def unsupported_pages(spark, sf):
    return pages.parse_pages(offer_pages(spark, sf))[1]


@query("structured_data_fields", SKILLED + """ SELECT id, title, company, location[1] AS city, salary_min, salary_max, CASE WHEN salary_min IS NOT NULL THEN salary_currency END AS salary_currency,
 array_to_string(skills_required, '|') AS skills, CASE WHEN id%2 = 0 THEN 'Remote' END AS work_type, date_added AS date_published FROM postings""")
def structured_data_fields(spark, sf):
    p = derived.postings(spark, sf, skills=True)
    html = F.concat(F.lit("<script type='application/ld+json'>"), _json_ld(F.col("id")), F.lit("</script>"))
    found = pages.extract_jsonld(p.select("id", F.lit("u").alias("url"), html.alias("html")))
    return pages.jsonld_fields(found, ("id",)).select(
        "id", "title", "company", "city", "salary_min", "salary_max", "salary_currency", F.array_join("skills", "|").alias("skills"), "work_type", "date_published"
    )


_SEEN = r"regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script\s*>', '', 'g'), '(?is)<style.*?</style\s*>', '', 'g'), '(?s)<!--.*?-->', '', 'g')"
_TEXT = r"""replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(seen, '(?s)<[^>]*>', '', 'g'), '&nbsp;', chr(160)), '&ndash;', chr(8211)),
 '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&apos;', chr(39)), '&amp;', '&')"""
_LEVELS = " ".join(f"WHEN contains(t, '{w}') THEN '{w}'" for w in fv.SENIORITY_ORDER_NF)


@query("page_tag_fields", rf"""WITH s AS (SELECT url, {_SEEN} AS seen FROM pages), x AS (SELECT *, {_TEXT} AS t, lower({_TEXT}) AS low FROM s)
 SELECT url, trim(regexp_replace(regexp_extract(seen, '(?is)<h1\b[^>]*>(.*?)</h1\s*>', 1), '(?s)<[^>]*>', '', 'g').replace('&amp;', '&')) AS title,
 CASE {_LEVELS} END AS seniority,
 CASE WHEN regexp_matches(low, 'zdalnie|remote') AND contains(low, 'hybryd') THEN 'Hybrid' WHEN regexp_matches(low, 'zdalnie|remote') THEN 'Remote'
  WHEN regexp_matches(low, 'hybryd|hybrid') THEN 'Hybrid' WHEN regexp_matches(low, 'stacjonarnie|onsite|on-site') THEN 'Onsite' END AS work_type,
 CAST(len(regexp_extract_all(seen, '(?i)<a\b')) AS INTEGER) AS links FROM x""")
def page_tag_fields(spark, sf):
    """Tag fields of all crawled pages."""
    found = pages.page_sections(derived.table(spark, sf, "pages"))
    text = F.col("text")
    return found.select(
        "url", "title", pages.first_listed(fv.SENIORITY_ORDER_NF, text).alias("seniority"), pages.work_type_of_text(text).alias("work_type"), F.size("links").alias("links"))
