"""Span lookup equals the per-term regular expression."""

import random
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from jobweave.operators import detect
from jobweave.operators.skew import TASK_ROWS, spread_if_few

TERMS = ["c", "c++", ".net", "ci/cd", "spring boot", "node.js", "a b c", "[x]", "ś", "r", "net", "|", "go lang", "c,", "boot/"]
ALPHABET = list("abcr.+/ ,;()[]|\n\té") + ["c++", ".net", "ci/cd", "spring boot", "node.js", "ś", "go", " "]
EDGE = r"[\s,;()\[\]/|.]"


def by_regex(texts):
    out = set()
    for i, t in enumerate(texts):
        for term in TERMS:
            if re.search(rf"(?:^|{EDGE}){re.escape(term.lower())}(?:{EDGE}|$)", t.lower()):
                out.add((i, term))
    return out


def by_spans(spark, texts):
    dictionary = spark.createDataFrame([(t,) for t in TERMS], "skill string")
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    return {(r.id, r.term) for r in detect.detect_terms(rows, dictionary).collect()}


def test_random_texts(spark):
    random.seed(3)
    texts = ["".join(random.choice(ALPHABET) for _ in range(random.randint(0, 40))) for _ in range(1500)]
    assert by_spans(spark, texts) == by_regex(texts)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from(ALPHABET), max_size=12).map("".join), min_size=1, max_size=60))
def test_any_texts(spark, texts):
    assert by_spans(spark, texts) == by_regex(texts)


def test_title_wins_and_listed_skills_are_left_out(spark):
    postings = spark.createDataFrame([
        (1, "Python dev", "we use python, Docker and Kafka", ["docker"], None), (2, None, "go (python)", [], ["Go"]), (3, "", None, None, None),
    ], "id int, title string, description string, skills_required array<string>, skills_nice_to_have array<string>")
    dictionary = spark.createDataFrame([("Python",), ("Docker",), ("Kafka",), ("Go",), (" ",)], "skill string")
    got = {tuple(r) for r in detect.detect_skills(postings, dictionary).collect()}
    assert got == {(1, "Python", "title"), (1, "Kafka", "description"), (2, "Python", "description")}


def test_detection_needs_no_shuffle_of_texts(spark):
    postings = spark.createDataFrame([(i, "t", "python") for i in range(100)], "id int, title string, description string").repartition(16)
    rows = postings.selectExpr("id", "title", "description", "array() as skills_required", "array() as skills_nice_to_have")
    plan = detect.detect_skills(rows, spark.createDataFrame([("python",)], "skill string"))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_tasks_grow_with_rows_read_in_few_large_ones(spark):
    cores = spark.sparkContext.defaultParallelism
    rows = spark.range(0, TASK_ROWS * (cores + 1), 1, cores).selectExpr("id", "CAST(id AS STRING) AS text")
    spread = spread_if_few(rows)
    assert spread.rdd.getNumPartitions() > cores
    assert spread.count() == TASK_ROWS * (cores + 1)


def test_keywords_of_a_text_are_distinct_without_a_shuffle_of_them(spark):
    dictionary = spark.createDataFrame([("Foo",), ("foo",), ("a b",), ("bar",)], "skill string")
    rows = spark.createDataFrame([(1, "foo foo! bar! a b x1"), (2, None), (None, "Foo"), (3, "bar")], "resume_id int, text string")
    found = detect.keywords(rows, dictionary)
    got = [(r.resume_id, r.keyword) for r in found.collect()]
    assert sorted(got, key=str) == sorted([(1, "foo"), (1, "Foo"), (1, "bar"), (1, "a b"), (1, "x1"), (None, "foo"), (None, "Foo"), (3, "bar")], key=str)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [resume_id" not in plan


def test_texts_that_share_a_key_share_their_keywords(spark):
    dictionary = spark.createDataFrame([("Foo",), ("a b",)], "skill string")
    rows = spark.createDataFrame([(1, "foo xx"), (1, "foo a b"), (None, "foo"), (None, "foo"), (2, "xx!")], "resume_id int, text string")
    got = [(r.resume_id, r.keyword) for r in detect.keywords(rows, dictionary).collect()]
    want = [(1, "foo"), (1, "Foo"), (1, "xx"), (1, "a b"), (None, "foo"), (None, "Foo"), (2, "xx")]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_title_wins_and_listed_skills_are_left_out(spark):
    dictionary = spark.createDataFrame([("Foo",), ("bar",), ("a b",)], "skill string")
    rows = spark.createDataFrame([(1, "foo a b", "foo bar", ["BAR", None], None), (2, None, "bar foo", None, ["x"])],
                                 "id int, title string, description string, skills_required array<string>, skills_nice_to_have array<string>")
    got = {tuple(r) for r in detect.detect_skills(rows, dictionary).select("job_id", "skill_name", "source_field").collect()}
    assert got == {(1, "Foo", "title"), (1, "a b", "title"), (2, "bar", "description"), (2, "Foo", "description")}


def test_runs_of_pieces_equal_those_made_by_hand(spark):
    """Runs made from shorter ones, and those too long for it, are the stretches between delimiters."""
    import random

    r = random.Random(4)
    texts = ["".join(r.choice(["aa", "B", "c", " ", ",", "", "/", "\n"]) for _ in range(r.randint(0, 14))) for _ in range(80)] + ["", None]
    frame = spark.createDataFrame(list(enumerate(texts)), "n int, text string").repartition(4)
    for counts in ([], [1], [2], [1, 3], [1, 2, 3, 4, 6]):
        got = {x.n: x.s for x in frame.select("n", detect.spans(F.col("text"), counts).alias("s")).collect()}
        for n, text in enumerate(texts):
            parts = re.split(r"([\s,;()\[\]/|.])", (text or "").lower())
            want = ["".join(parts[2 * i:2 * (i + k) - 1]) for k in counts for i in range(len(parts) // 2 + 2 - k)]
            assert sorted(got[n]) == sorted(set(want)), (counts, text)


def test_keywords_are_made_once_for_their_canonical_forms(spark):
    from jobweave.operators import skills

    made = spark.sparkContext.accumulator(0)

    def count(rows):
        for part in rows:
            made.add(len(part))
            yield part

    words = spark.createDataFrame([(1, "go"), (1, "GO"), (1, "xx"), (2, "sql"), (None, "go"), (3, "go")], "resume_id int, keyword string")
    known = spark.createDataFrame([("Go",), ("SQL",)], "skill string")
    got = skills.canonical_resume_skills(words.mapInPandas(count, words.schema), known)
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, "Go"), (2, "SQL"), (None, "Go"), (3, "Go")], key=str)
    assert made.value == 6  # twice, before: for the skills and for the resumes without any


def test_extra_keywords_shuffle_no_found_ones(spark):
    from jobweave.operators import skills

    found = spark.createDataFrame([(1, "go"), (1, "term a"), (None, "go"), (2, "x")], "resume_id int, keyword string")
    extra = spark.createDataFrame([(1, "term a"), (1, "term a"), (None, "go"), (3, "y"), (3, None), (3, None)], "resume_id int, keyword string")
    both = skills.with_extra_keywords(found, extra)
    want = [(1, "go"), (1, "term a"), (None, "go"), (2, "x"), (3, "y"), (3, None)]
    assert sorted(map(tuple, both.collect()), key=str) == sorted(want, key=str)
    assert both._jdf.queryExecution().optimizedPlan().toString().startswith("Union")
