"""SQL of the derived views (see ``sources.derived``), as CTE prefixes for the twins."""

_SKILLS = """
sk AS (SELECT l_orderkey,
  list_sort(list_distinct(flatten(list(string_split(p_name,' '))))) AS req,
  list_sort(list_distinct(list(p_type))) AS nice
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey)"""

_SKILLS_REPEATED = """
sk AS (SELECT l_orderkey, list_sort(flatten(list(string_split(p_name,' ')))) AS req, list_sort(list(p_type)) AS nice
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey)"""

_POSTINGS = """
postings AS (SELECT o_orderkey AS id,
  'https://src' || CAST(o_orderkey%3 AS VARCHAR) || '.example/job/' || CAST(o_orderkey AS VARCHAR) AS url,
  'src' || CAST(o_orderkey%3 AS VARCHAR) AS source,
  c_mktsegment || ' ' || o_orderpriority AS title, c_name AS company, [n_name, r_name] AS location,
  CASE WHEN o_orderkey%11<>0 THEN pay END AS salary_min,
  CASE WHEN o_orderkey%11<>0 AND o_orderkey%4<>0 THEN pay*1.25 END AS salary_max,
  CASE o_orderkey%5 WHEN 0 THEN 'PLN' WHEN 1 THEN 'USD' WHEN 2 THEN 'EUR' WHEN 3 THEN 'GBP' ELSE 'XYZ' END AS salary_currency,
  CASE o_orderkey%9 WHEN 0 THEN '100 PLN/h' WHEN 1 THEN '500/day' WHEN 2 THEN 'B2B' WHEN 3 THEN 'Permanent' END AS salary_type,
  {skills}
  CASE WHEN o_orderkey%2=0 THEN ['B2B'] END AS employment_types,
  o_orderpriority AS seniority,
  CASE WHEN o_orderkey%7=0 THEN NULL WHEN o_orderkey%3=0 THEN 'Remote' WHEN o_orderkey%3=1 THEN 'Hybrid' ELSE 'Onsite' END AS work_type,
  c_mktsegment AS category, o_orderkey%10=0 AS is_reposted,
  strftime(o_orderdate, '%Y-%m-%d') AS date_added,
  o_orderstatus AS status, o_orderkey%13=0 AS saved, o_orderdate AS created_at{description}
 FROM (SELECT *, CASE WHEN o_orderkey%6=0 THEN o_totalprice/1000 ELSE o_totalprice END AS pay FROM orders)
 JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey
 JOIN region ON n_regionkey=r_regionkey{joins})"""

_LISTS = "coalesce(req, []::varchar[]) AS skills_required, coalesce(nice, []::varchar[]) AS skills_nice_to_have,"
_JOIN_SKILLS = " LEFT JOIN sk ON l_orderkey=o_orderkey"
_JOIN_TEXT = " LEFT JOIN documents ON doc_id=o_orderkey"

PLAIN = "WITH " + _POSTINGS.format(skills="", description=", NULL::VARCHAR AS description", joins="")
SKILLED = "WITH " + _SKILLS + "," + _POSTINGS.format(skills=_LISTS, description="", joins=_JOIN_SKILLS)
REPEATED = "WITH " + _SKILLS_REPEATED + "," + _POSTINGS.format(skills=_LISTS, description="", joins=_JOIN_SKILLS)
DESCRIBED = "WITH " + _SKILLS + "," + _POSTINGS.format(
    skills=_LISTS, description=", text AS description", joins=_JOIN_SKILLS + _JOIN_TEXT
)

# Rounds to cents by the exact binary value, as printf does.
CENTS = "CAST(printf('%.2f', {}) AS DOUBLE)"

_RATE = "CASE salary_currency WHEN 'PLN' THEN 1.0 WHEN 'USD' THEN 4.0 WHEN 'EUR' THEN 4.3 WHEN 'GBP' THEN 5.1 WHEN 'CHF' THEN 4.5 END::DOUBLE"


def _pln(column: str) -> str:
    return f"CASE WHEN salary_currency='PLN' THEN {column} WHEN ({_RATE}) IS NOT NULL THEN {CENTS.format(f'{column}*({_RATE})')} END"


def _monthly(column: str) -> str:
    return (
        f"CASE WHEN {column} IS NULL THEN NULL WHEN salary_period='hourly' THEN {CENTS.format(f'{column}*160')} "
        f"WHEN salary_period='daily' THEN {CENTS.format(f'{column}*20')} ELSE {column} END"
    )


_PERIOD = """CASE WHEN salary_min IS NULL AND salary_max IS NULL THEN NULL
 WHEN salary_type LIKE '%/h%' THEN 'hourly' WHEN salary_type LIKE '%/day%' THEN 'daily'
 WHEN salary_currency='PLN' AND salary_max>0 AND salary_max<500 THEN 'hourly'
 WHEN salary_currency IN ('USD','EUR') AND salary_max>0 AND salary_max<120 THEN 'hourly' ELSE 'monthly' END"""


def with_salary(prefix: str) -> str:
    """Add CTE ``paid``: postings with salary_period, salary_min_pln and salary_max_pln."""
    return prefix + f""",
converted AS (SELECT *, {_PERIOD} AS salary_period, {_pln('salary_min')} AS lo, {_pln('salary_max')} AS hi FROM postings),
paid AS (SELECT * EXCLUDE (lo, hi), {_monthly('lo')} AS salary_min_pln, {_monthly('hi')} AS salary_max_pln FROM converted)"""


PAID = with_salary(PLAIN)
PAID_SKILLED = with_salary(SKILLED)

TEXT_POSTINGS = """WITH words AS (SELECT *, list_filter(regexp_split_to_array(text, '[^\\p{L}]+'), lambda w: length(w) >= 2) AS w FROM documents),
tp AS (SELECT doc_id AS id, 'https://' || source || '.example/doc/' || doc_id AS url, source,
  string_split(text, chr(10))[1] AS title, source || '-' || lang AS company, lang AS category,
  list_slice(w, 1, 2) AS skills_required,
  list_filter([array_to_string(list_slice(w, 1, 2), ' ')], lambda s: s <> '') AS skills_nice_to_have, text AS description FROM words),
known AS (SELECT DISTINCT trim(s) AS skill FROM (SELECT unnest(list_concat(skills_required, skills_nice_to_have)) AS s FROM tp) WHERE trim(s) <> '')"""

LOG = """WITH log AS (SELECT ts AS created_at, event_type AS model,
  CASE WHEN event_id%7<>0 THEN CAST(floor(value) AS BIGINT) END AS latency_ms,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS input_tokens,
  CASE WHEN event_id%5<>0 THEN event_id%50 END AS output_tokens, user_id FROM events)"""

RESUMES = """resumes AS (SELECT c_custkey AS resume_id, unnest(list_concat(list_transform(string_split(p_name, ' '), lambda w: upper(w)), [p_type])) AS skill
  FROM customer JOIN part ON c_custkey = p_partkey)"""
