"""Column functions on posting text: keys, names, tokens, documents, prompts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobweave import fixed_values as fv


def no_strings() -> Column:
    return F.array().cast("array<string>")


def strings_or_empty(arr: Column) -> Column:
    return F.coalesce(arr, no_strings())


def all_skills(required: str | Column = "skills_required", nice: str | Column = "skills_nice_to_have") -> Column:
    """Both skill lists in order, duplicates kept; a NULL list counts as empty."""
    req = F.col(required) if isinstance(required, str) else required
    opt = F.col(nice) if isinstance(nice, str) else nice
    return F.concat(strings_or_empty(req), strings_or_empty(opt))


def norm_skill(skill: Column) -> Column:
    return F.lower(strip(F.coalesce(skill, F.lit(""))))


def with_once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, where the value is made once however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def strip(text: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def is_blank(text: Column) -> Column:
    return F.trim(F.coalesce(text, F.lit(""))) == ""


def present(text: Column) -> Column:
    return text.isNotNull() & (text != "")


def first_filled(*texts: Column) -> Column:
    return F.coalesce(*[F.nullif(t, F.lit("")) for t in texts])


def title_words(text: Column) -> Column:
    """Upper-case each letter that follows a non-letter, lower-case the others.

    ``initcap`` only breaks at blanks, so other breaks are walked with a split that keeps
    runs of letters and runs of non-letters apart.
    """
    runs = F.regexp_extract_all(text, F.lit(r"(\p{L}+|[^\p{L}]+)"), 1)
    return F.array_join(
        F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, 2, 1 << 30)))),
        "",
    )


def capitalize(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 1 << 30)))


def _lookup(table: dict[str, str], key: Column) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.element_at(F.create_map(*pairs), key)


def format_category(raw: Column) -> Column:
    """Board slug to display name: known names first, else split camel case and title-case."""
    squeezed = F.regexp_replace(F.lower(strip(raw)), "[ _-]", "")
    spaced = F.regexp_replace(raw, "(?<=[a-z])(?=[A-Z])", " ")
    fallback = title_words(strip(F.regexp_replace(spaced, "[-_]", " ")))
    return F.when(
        present(raw),
        F.coalesce(
            _lookup(fv.CATEGORY_NAMES, squeezed),
            _lookup(fv.CATEGORY_NAMES, F.lower(raw)),
            F.nullif(fallback, F.lit("")),
        ),
    )


def category_from_suffix(url: Column) -> Column:
    """Category named by the last dash-separated part of the last path segment."""
    slug = F.element_at(F.split(F.regexp_replace(url, "/+$", ""), "/"), -1)
    return _lookup(fv.SUFFIX_CATEGORIES, F.lower(F.element_at(F.split(slug, "-"), -1)))


def category_from_path(url: Column) -> Column:
    """Category named by the last path segment that is a known category."""
    segments = F.transform(F.split(F.regexp_replace(url, "/+$", ""), "/"), F.lower)
    known = F.filter(F.reverse(segments), lambda s: s.isin(list(fv.URL_CATEGORIES)))
    return _lookup(fv.URL_CATEGORIES, F.try_element_at(known, F.lit(1)))


def normalize_work_type(raw: Column) -> Column:
    low = F.lower(F.coalesce(raw, F.lit("")))
    return (
        F.when(low.rlike("remote|telecommute"), "Remote")
        .when(low.rlike("hybrid|partly"), "Hybrid")
        .when(low.rlike("office|onsite"), "Onsite")
        .when(low != "", capitalize(raw))
    )


def tokenize(text: Column) -> Column:
    """Distinct lower-case word tokens of two or more characters, stop words dropped."""
    words = F.regexp_extract_all(
        F.coalesce(text, F.lit("")), F.lit(r"([a-zA-Z0-9]+(?:-[a-zA-Z0-9]+)*)"), 1
    )
    stop = F.array(*[F.lit(w) for w in fv.STOPWORDS])
    kept = F.filter(F.transform(words, F.lower), lambda w: F.length(w) >= 2)
    return F.array_except(kept, stop)


def _joined(*parts: Column) -> Column:
    text = strip(F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts]))
    return F.when(text == "", "unknown").otherwise(text)


def posting_text() -> Column:
    """Text of a posting that is embedded, whole."""
    return _joined(
        F.col("title"), F.col("company"), F.col("category"),
        F.array_join(strings_or_empty(F.col("skills_required")), " "),
        F.array_join(strings_or_empty(F.col("skills_nice_to_have")), " "),
        F.col("description"),
    )


def rerank_text() -> Column:
    """Text of a search hit that a pair scorer reads, whole."""
    return _joined(
        F.col("title"), F.col("company"), F.col("category"), F.col("skills_combined"),
        F.col("description"),
    )


def skills_combined() -> Column:
    return F.array_join(all_skills(), " ")


# --- embedding input -----------------------------------------------------------

def embed_profile(source: Column, model: Column, explicit: Column, *, built: bool = False) -> Column:
    """Input profile of a model.  ``built`` names the one an older index was built with."""
    low = F.lower(strip(F.coalesce(model, F.lit(""))))
    given = strip(F.coalesce(explicit, F.lit("")))
    return (
        F.when(F.lower(strip(F.coalesce(source, F.lit("")))) == "openai", "openai-v1")
        .when(given != "", given)
        .when(low.contains("nomic-embed-text"), "nomic-legacy-v1" if built else "nomic-search-v1")
        .when(low.contains("bge"), "bge-v1")
        .otherwise("raw-v1")
    )


def embedding_input(text: Column, profile: Column, usage: Column) -> Column:
    """Text with the prefix its profile and usage ask for.  A model that reads less takes it in parts."""
    clean = strip(F.coalesce(text, F.lit("")))
    query = usage == "query"
    prefix = (
        F.when((profile == "bge-v1") & query, fv.BGE_QUERY_PREFIX)
        .when((profile == "nomic-search-v1") & query, fv.NOMIC_QUERY_PREFIX)
        .when(profile == "nomic-search-v1", fv.NOMIC_DOCUMENT_PREFIX)
        .otherwise("")
    )
    return F.when(clean == "", "").otherwise(
        F.concat(prefix, clean)
    )


def content_key(prepared: Column, model: Column, source: Column, profile: Column, usage: Column) -> Column:
    return F.sha2(
        F.concat_ws("|", prepared, model, source, profile, usage), 256
    )


# --- prompt hygiene ------------------------------------------------------------

_INJECTION = "(?i)" + "|".join(f"(?:{p})" for p in fv.INJECTION_PATTERNS)


def _printable_lines(text: Column) -> Column:
    printable = F.regexp_replace(
        F.coalesce(text, F.lit("")), r"[\p{Cc}\p{Cf}\p{Cs}\p{Co}\p{Cn}\p{Zl}\p{Zp}\p{Zs}&&[^ \n\t]]", ""
    )
    return F.split(printable, "\n")


def safe_lines(text: Column) -> Column:
    """Lines left after unprintable characters and lines with injected instructions go."""
    return F.filter(_printable_lines(text), lambda line: ~line.rlike(_INJECTION))


def sanitize_for_prompt(text: Column, limit: int | None = None) -> Column:
    """The safe lines; ``limit`` is for prompts that hold no more characters."""
    safe = strip(F.array_join(safe_lines(text), "\n"))
    return safe if limit is None else F.substring(safe, 1, limit)


def flagged_lines(text: Column) -> Column:
    """How many lines :func:`safe_lines` takes out."""
    return F.size(F.filter(_printable_lines(text), lambda line: line.rlike(_INJECTION)))


def usable_url(url: Column) -> Column:
    clean = strip(F.coalesce(url, F.lit("")))
    return (F.length(clean) > 20) & (clean.startswith("http://") | clean.startswith("https://"))


# --- text fields of pages and model answers --------------------------------------

def iso_day(stamp: Column) -> Column:
    """Date part of an ISO date-time; NULL for a blank one."""
    return F.nullif(F.element_at(F.split(stamp, "T"), 1), F.lit(""))


def epoch_day(millis: Column) -> Column:
    """UTC day of an epoch time, whatever the session's zone; NULL for 0."""
    return F.when(millis != 0, F.date_from_unix_date(F.floor(millis / 86_400_000).cast("int")).cast("string"))


def expiry_day(text: Column) -> Column:
    """dd.mm.yyyy or dd/mm/yyyy after an expiry phrase, as an ISO day."""
    pattern = r"(?iu)(?:ważna do|valid until)[:\s]*(\d{2})[./](\d{2})[./](\d{4})"
    part = lambda t, i: F.regexp_extract(t, pattern, i)
    # Found once; the parts are read from the place itself.
    return with_once(part(text, 0), lambda t: F.when(t != "", F.concat_ws("-", part(t, 3), part(t, 2), part(t, 1))))


def detect_entry_period(entry: dict[str, Column]) -> Column:
    """Pay period named by the first readable of the three keys of a salary entry."""
    tests = []
    for key in fv.PERIOD_KEYS:
        low = F.lower(entry[key])
        chain = None
        for period, words in fv.EXPLICIT_PERIODS.items():
            test = low.isin(words)
            chain = F.when(test, period) if chain is None else chain.when(test, period)
        tests.append(chain)
    return F.coalesce(*tests)


_QUOTED = r'"((?:[^"\\]|\\.)*)"'


def _answered_list(raw: Column, key: str) -> Column:
    """The texts that an answer lists under ``key``, as it stands: the first JSON object that has
    the key; where none reads, the quoted texts between the brackets that follow the key."""
    starts = F.filter(F.split(raw, r"(?=\{)"), lambda part: part.startswith("{"))
    whole = F.transform(starts, lambda part: F.from_json(part, f"`{key}` array<string>")[key])
    read = F.try_element_at(F.filter(whole, lambda names: names.isNotNull()), F.lit(1))
    after = F.regexp_extract(raw, rf'(?s)"{key}"\s*:\s*\[([^\]]*)\]', 1)
    return F.coalesce(read, F.regexp_extract_all(after, F.lit(_QUOTED), 1))


def _names(texts: Column) -> Column:
    return F.filter(F.transform(texts, strip), lambda s: s.isNotNull() & (s != ""))


def parse_skill_answer(raw: Column) -> Column:
    """Different skill names in a model answer: those under ``skills``, else those of a bare list."""
    under = _names(_answered_list(raw, "skills"))
    bare = _names(F.regexp_extract_all(F.regexp_extract(raw, r"(?s)\[([^\]]*)\]", 1), F.lit(_QUOTED), 1))
    return F.array_distinct(F.when(raw.contains('"skills"'), under).otherwise(bare))


def parse_query_answer(raw: Column) -> Column:
    """Query variants in a model answer, in order; empty where nothing reads."""
    return F.coalesce(_names(_answered_list(raw, "queries")), no_strings())


def salary_range_text(text: Column) -> Column:
    """First salary range in running text as struct(min, max, currency, type).

    Amounts group their digits by white space or by commas; the form with white space is tried
    first.  What surrounds the range tells the kind of contract.
    """
    codes = "|".join(fv.SALARY_CURRENCIES)

    def read(flat: Column, group: str, fraction: str) -> Column:
        amount = rf"\d[\d{group}]*(?:{fraction}\d+)?"
        # The range with its surroundings, found once: before, from, to, currency, after.
        near = fv.SALARY_CONTEXT_CHARS
        pattern = rf"(?s)(.{{0,{near}}}?)({amount})\s*[–-]\s*({amount})\s*({codes})(.{{0,{near}}})"
        # Surroundings are only looked for where there is a range at all; the parts are then read from the short text found.
        place = F.when(flat.rlike(rf"{amount}\s*[–-]\s*{amount}\s*(?:{codes})"), F.regexp_extract(flat, pattern, 0))
        value = lambda digits: F.translate(digits, " ,\t\n", "").try_cast("double")

        def whole(part: Column) -> Column:
            around = F.concat(*[part[f"p{i}"] for i in range(1, 6)])
            permanent = around.contains("UoP") | around.contains("Permanent") | F.lower(around).contains("umowa o prac")
            kind = F.when(around.contains("B2B"), "B2B").when(permanent, "Permanent").otherwise("")
            return F.when(value(part["p2"]).isNotNull() & (value(part["p3"]) >= fv.SALARY_TEXT_FLOOR), F.struct(
                value(part["p2"]).alias("min"), value(part["p3"]).alias("max"), part["p4"].alias("currency"), kind.alias("type")))

        parts = lambda t: F.struct(*[F.regexp_extract(t, pattern, i).alias(f"p{i}") for i in range(1, 6)])
        return with_once(place, lambda t: F.when(t.isNotNull(), with_once(parts(t), whole)))

    return with_once(F.translate(text, "\u00a0\u202f", "  "), lambda flat: F.coalesce(read(flat, r"\s", "[.,]"), read(flat, ",", r"\.")))


def short_skills(skills: Column) -> Column:
    """Skills that are short enough to be names."""
    return F.filter(skills, lambda s: F.length(s) < fv.MAX_SKILL_LENGTH)


def long_skills(skills: Column) -> Column:
    """The others, which are reported and not listed."""
    return F.filter(skills, lambda s: F.length(s) >= fv.MAX_SKILL_LENGTH)
