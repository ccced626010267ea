"""Search, fusion, matching and recall against brute force and literal cases."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from jobweave.operators import dedup, embed, evaluate, fusion, recommend, search, skills, vectors


# --- vectors --------------------------------------------------------------------------------

def brute_knn(base, asked, k):
    unit = lambda m: m / np.linalg.norm(m, axis=1)[:, None]
    sims = np.round(unit(asked) @ unit(base).T, 10)
    return {i: list(np.argsort(-s, kind="stable")[:k]) for i, s in enumerate(sims)}


@pytest.mark.parametrize("shape", ["random", "clustered", "copies", "near copies"])
def test_knn_is_exact(spark, shape, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_NUMBERS", 8)  # blocks of 256 rows
    monkeypatch.setattr(vectors, "SIMILARITIES", 500)
    rng = np.random.default_rng(4)
    if shape == "random":
        base = rng.normal(size=(700, 8))
    elif shape == "clustered":
        base = np.repeat(rng.normal(size=(12, 8)), 60, axis=0) + rng.normal(scale=0.02, size=(720, 8))
    else:
        base = np.concatenate([np.ones((300, 8)), rng.normal(size=(300, 8))])
    asked = rng.normal(size=(40, 8))
    if shape == "near copies":  # queries a hair beside stored vectors
        base = np.repeat(rng.normal(size=(100, 8)), 6, axis=0) + rng.normal(scale=1e-7, size=(600, 8))
        asked = base[rng.integers(0, 600, 40)] + rng.normal(scale=1e-8, size=(40, 8))
    frame = lambda m, name: spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], f"{name} long, embedding array<double>")
    index = vectors.build_vector_index(frame(base, "job_id"))
    hits = vectors.search_knn(index, frame(asked, "query_id"), top_k=7).collect()
    want = brute_knn(base, asked, 7)
    got = {q: [h.job_id for h in sorted((h for h in hits if h.query_id == q), key=lambda h: h.rank)] for q in want}
    assert got == want
    # One plane: both sides of it are looked at, so nothing can be missed.
    some = vectors.search_hyperplanes(index, frame(asked, "query_id"), top_k=7, planes=vectors.Hyperplanes(tables=3, bits=1)).collect()
    assert sorted(some) == sorted(hits)


def test_blocks_meet_once(spark):
    """Every row of one side meets every row of the other in one cell, however many blocks there are."""
    import pyarrow as pa
    from pyspark.sql import types as T

    from jobweave.operators.blocks import Grid, meet_blocks

    a, b = spark.range(50).withColumnRenamed("id", "a"), spark.range(70).withColumnRenamed("id", "b")
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def work(x, y):
        pairs = [(i, j) for i in x["a"].to_pylist() for j in y["b"].to_pylist()]
        return pa.table({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})

    got = meet_blocks(a, b, (F.xxhash64("a"), F.xxhash64("b")), Grid(4, 7, 5), work, schema).collect()
    assert len(got) == len(set(got)) == 50 * 70


def test_both_sides_of_a_grid_are_cut_alike():
    """A row of either side is copied no more often where the tables are ten times as large."""
    from jobweave.operators.blocks import Grid

    small, large = (Grid.over(n, n, 32_768, 200) for n in (10_250, 102_500))
    assert small.left + small.right <= large.left + large.right <= small.left + small.right + 2 < 50
    assert large.left * large.right >= 2 * 200
    assert Grid.over(200, 102_500, 32_768, 200).left == 1 and Grid.over(700_000, 700_000, 32_768, 4).right == 22


def test_vectors_of_other_lengths_are_named(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0]), (4, None)], "job_id long, embedding array<double>")
    index = vectors.build_vector_index(df)
    assert sorted(r.job_id for r in index.rejected.collect()) == [3, 4]
    usable, other = index.split_queries(df.withColumnRenamed("job_id", "query_id"))
    assert usable.count() == 2 and sorted(r.query_id for r in other.collect()) == [3, 4]


def test_knn_with_few_vectors_and_zero_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [0.0, 1.0])], "job_id long, embedding array<double>")
    asked = spark.createDataFrame([(9, [2.0, 1.0]), (8, [1.0])], "query_id long, embedding array<double>")
    hits = vectors.search_knn(vectors.build_vector_index(df), asked, top_k=5).orderBy("rank").collect()
    assert [(h.query_id, h.job_id) for h in hits] == [(9, 1), (9, 3)]


# --- keyword --------------------------------------------------------------------------------

def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i] + [0] * len(b), row
        for j, y in enumerate(b, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
    return row[-1]


def test_fuzzy_expansion_equals_brute_force(spark):
    import random

    random.seed(2)
    word = lambda: "".join(random.choice("abcé") for _ in range(random.randint(1, 8)))
    docs = [(i, " ".join(word() for _ in range(12)), "", "", "") for i in range(40)]
    frame = spark.createDataFrame(docs, "job_id long, title string, company string, skills_combined string, description string")
    index = search.build_index(frame, {"title": 1.0})
    queries = [(i, " ".join(word() for _ in range(4))) for i in range(8)]
    terms = search._query_terms(spark.createDataFrame(queries, "query_id long, query_text string"), index, "query_id", "query_text")
    got = {(r.query_id, r.term): round(r.n, 9) for r in search.expand_fuzzy(terms, index).collect()}
    vocabulary = {w for d in docs for w in d[1].split()}
    want = {}
    for q, text in queries:
        for asked in text.split():
            limit = 0 if len(asked) <= 2 else 1 if len(asked) <= 5 else 2
            for term in vocabulary:
                d = _edits(asked, term)
                if d <= limit and d < min(len(asked), len(term)):
                    want[q, term] = want.get((q, term), 0) + 1 - d / min(len(asked), len(term))
    assert got == {k: round(v, 9) for k, v in want.items()}


def test_company_matches_only_as_a_whole(spark):
    docs = spark.createDataFrame([(1, "dev", "Acme Ltd", "", ""), (2, "dev", "Acme", "", "")], "job_id long, title string, company string, skills_combined string, description string")
    queries = spark.createDataFrame([(1, " Acme "), (2, "acme"), (3, "  ")], "query_id long, query_text string")
    hits = search.search_keyword(search.build_index(docs), queries).collect()
    assert [(h.query_id, h.job_id) for h in hits] == [(1, 2)]


def test_documents_of_frequent_terms_only_are_not_scored(spark):
    """The hits are those of scoring every pair, while the documents that share only common words are never met."""
    import random

    r = random.Random(3)
    common = ["the", "and", "with"]
    docs = [(i, " ".join(r.choices(common, k=6) + ([f"rare{i % 40}"] * r.randrange(1, 4) if i % 5 == 0 else ["plain"])), "", "", "") for i in range(600)]
    frame = spark.createDataFrame(docs, "job_id long, title string, company string, skills_combined string, description string")
    queries = spark.createDataFrame([(q, f"the rare{5 * q} and with the rare{5 * q + 5}") for q in range(5)], "query_id long, query_text string")
    index = search.build_index(frame, {"title": 1.0, "description": 2.0})
    terms = search._query_terms(queries, index, "query_id", "query_text")
    rows, weighted = search.weigh(index, terms)
    some = search.candidates(rows, search.needed_terms(rows, weighted, 5))
    every = rows.join(weighted, ["field", "term"]).select("job_id", "query_id", "field").distinct()
    want = search.top_k_per_query(search.score_candidates(rows, weighted, every), 5).collect()
    assert sorted(search.search_keyword(index, queries, top_k=5).collect()) == sorted(want) and len(want) == 25
    assert every.count() == 5 * 600 and some.count() <= 5 * 40
    # Without enough hits for a bound every document that shares a term is a candidate.
    assert search.candidates(rows, search.needed_terms(rows, weighted, 1_000)).count() == every.count()
    assert len(search.search_keyword(index, queries, top_k=1_000).collect()) == 5 * 600


@pytest.mark.parametrize("products", [1, 200, 1 << 20])
def test_best_of_a_task_equals_brute_force(monkeypatch, products):
    """Documents in the order of their ids, two fields, ties: the first of equal ones stay, however they are cut into pieces."""
    import random

    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(search, "PRODUCTS", products)
    r = random.Random(5)
    weights = [{(t, q): float(r.randrange(1, 4)) for t in terms for q in range(4) if r.random() < 0.6 or q == t % 4} for terms in (range(5), range(5, 8))]
    docs = [(100 + i, sorted(r.sample(range(8), r.randrange(1, 6)))) for i in range(60)]
    parts = {(i, t): float(r.randrange(1, 3)) for i, ts in docs for t in ts}
    batches = [pa.RecordBatch.from_pydict({
        "job_id": [i for i, _ in some], "_t": pa.array([ts for _, ts in some], pa.list_(pa.int32())), "_part": pa.array([[parts[i, t] for t in ts] for i, ts in some], pa.list_(pa.float64()))})
        for some in (docs[:23], docs[23:])]
    cells = [tuple(np.array(c) for c in ([t for t, _ in w], [q for _, q in w], list(w.values()))) for w in weights]
    out = [row for b in search._best_of_task(batches, cells, 4, 7, 9) for row in b.to_pylist()]
    want = []
    for q in range(4):
        scores = {i: max(sums) for i, ts in docs if (sums := [sum(w[t, q] * parts[i, t] for t in ts if (t, q) in w) for w in weights if any((t, q) in w for t in ts)])}
        want += [(q, i, scores[i]) for i in sorted(scores, key=lambda i: (-scores[i], i))[:7]]
    assert sorted((x["_q"], x["job_id"], x["score"]) for x in out) == sorted(want)


def test_shared_terms_shuffle_no_pairs(spark, monkeypatch):
    """Passages of common words: scores of all pairs are made in the tasks; repeated and null ids count as in the join."""
    import random

    r = random.Random(4)
    words = "the and with from into".split()
    docs = [(None if i < 2 else i // 2 * 2 if i % 10 == 0 else i - i % 3 % 2, " ".join(r.choices(words, k=r.randrange(1, 9))), "", "", " ".join(r.choices(words, k=3))) for i in range(300)]
    frame = spark.createDataFrame(docs, "job_id long, title string, company string, skills_combined string, description string").repartition(5)
    queries = spark.createDataFrame([(q, " ".join(r.choices(words, k=4))) for q in range(9)] + [(None, "the into")], "query_id long, query_text string")
    index = search.build_index(frame, {"title": 2.0, "description": 1.0})
    rows, weighted = search.weigh(index, search._query_terms(queries, index, "query_id", "query_text"))
    want = search.top_k_per_query(search._best_field(rows.join(weighted, ["field", "term"]), 9), 8).collect()
    monkeypatch.setattr(search, "_best_field", None)  # the form that shuffles a row for each pair
    monkeypatch.setattr(search, "needed_terms", None)
    hits = search.search_keyword(index, queries, top_k=8)
    assert {tuple(h) for h in hits.collect()} == {tuple(h) for h in want} and len(want) == 80
    # Read again, the list is not made again.
    assert "MapInArrow" not in (plan := hits._jdf.queryExecution().executedPlan().toString()) and "Window" not in plan


def test_stored_index_gives_the_same_hits(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"dev {'python' if i % 2 else 'go'}", "", "sql", "text " * i) for i in range(20)], "job_id long, title string, company string, skills_combined string, description string")
    queries = spark.createDataFrame([(1, "python sql"), (2, "text go")], "query_id long, query_text string")
    index = search.build_index(docs)
    search.write_index(index, str(tmp_path / "index"))
    want = search.search_keyword(index, queries, top_k=5)
    got = search.search_keyword(search.read_index(spark, str(tmp_path / "index")), queries, top_k=5)
    assert want.count() == 10 and got.exceptAll(want).isEmpty()


# --- fusion -----------------------------------------------------------------------------------

LIST = "query_id long, job_id string, rank long, score double"


def test_pair_in_both_lists_keeps_leg_scores(spark):
    a = spark.createDataFrame([(1, "x", 1, 9.0)], LIST)
    b = spark.createDataFrame([(1, "x", 1, 0.8)], LIST)
    r = fusion.rrf_pair(a, b).first()
    assert (r.from_keyword, r.from_semantic, r.keyword_rank, r.semantic_rank, r.keyword_score, r.semantic_score) == (True, True, 1, 1, 9.0, 0.8)


def test_one_empty_list_keeps_raw_scores(spark):
    a = spark.createDataFrame([(1, "x", 1, 9.0), (1, "y", 2, 5.0)], LIST)
    rows = fusion.rrf_pair(a, a.limit(0)).orderBy("rank").collect()
    assert [(r.job_id, r.score) for r in rows] == [("x", 9.0), ("y", 5.0)]


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.permutations("abcdefgh"), min_size=2, max_size=4), st.integers(1, 8))
def test_multi_equals_loop(spark, orders, depth):
    rows = [(1, i, j, r + 1, 1.0 / (r + 1)) for i, o in enumerate(orders) for r, j in enumerate(o[:depth])]
    got = fusion.rrf_multi(spark.createDataFrame(rows, "query_id long, list_id int, job_id string, rank long, score double")).collect()
    want = {}
    for _, _, j, r, _ in rows:
        want[j] = want.get(j, 0) + 1 / (60 + r)
    order = sorted(want, key=lambda j: (-round(want[j], 12), j))
    assert [r.job_id for r in sorted(got, key=lambda r: r.rank)] == order


def test_multi_passes_a_single_list_through(spark):
    rows = spark.createDataFrame([(1, 5, "x", 1, 3.0), (1, 5, "y", 2, 3.5)], "query_id long, list_id int, job_id string, rank long, score double")
    assert [(r.rank, r.job_id, r.score) for r in fusion.rrf_multi(rows).orderBy("rank").collect()] == [(1, "x", 3.0), (2, "y", 3.5)]


def test_rerank_passthrough(spark):
    hits = spark.createDataFrame([(1, "x", 1, 9.0), (1, "y", 2, 5.0), (2, "x", 1, 1.0)], LIST)
    docs = spark.createDataFrame([("x", "", "", "", "", ""), ("y", "python dev", "", "", "", "")], "job_id string, title string, company string, category string, skills_combined string, description string")
    queries = spark.createDataFrame([(1, "python"), (2, " ")], "query_id long, query_text string")
    reranked = {(r.query_id, r["rank"]): r.job_id for r in fusion.rerank(hits, queries, docs).collect()}
    assert reranked == {(1, 1): "y", (1, 2): "x", (2, 1): "x"}
    partial = fusion.rerank(hits, queries, docs, score_fn=lambda q, t: F.when(t != "unknown", F.lit(1.0)))
    assert {(r.query_id, r["rank"]): r.job_id for r in partial.collect()} == {(1, 1): "x", (1, 2): "y", (2, 1): "x"}
    assert fusion.rerank(hits, queries, docs, top_k=1, score_fn=None).count() == 2


def test_texts_of_hits_only_are_put_together(spark):
    hits = spark.createDataFrame([(1, "y", 1, 9.0)], LIST)
    docs = spark.createDataFrame([("x", "a", "", "", "", ""), ("y", "python", "", "", "", "")], "job_id string, title string, company string, category string, skills_combined string, description string")
    queries = spark.createDataFrame([(1, "python")], "query_id long, query_text string")
    ranked = fusion.rerank(hits, queries, docs)
    assert "LeftSemi" in ranked._jdf.queryExecution().optimizedPlan().toString()
    assert [(h.job_id, h.rank, h.rerank_score) for h in ranked.collect()] == [("y", 1, 1.0)]


def test_merge_of_keyword_and_semantic(spark):
    row = "query_id long, rank long, job_id string, title string, company string"
    keyword = spark.createDataFrame([(1, 1, "a", "Dev", "Acme"), (1, 2, "z", "", None)], row)
    semantic = spark.createDataFrame([(1, 1, "b", "Dev", "Acme"), (1, 2, "c", "Engineer", "Beta"), (1, 3, "d", "Ops", "Beta")], row)
    ordered = lambda limit: [r.job_id for r in dedup.merge_keyword_semantic(keyword, semantic, limit=limit).orderBy("position").collect()]
    assert ordered(8) == ["a", "c", "d"] and ordered(2) == ["a", "c"]


def test_relevance_of_equal_scores(spark):
    hits = spark.createDataFrame([(1, f"j{i}", i, 2.0) for i in range(1, 9)], LIST)
    assert [r.relevance for r in fusion.relevance_percent(hits).orderBy("rank").collect()] == [100, 90, 80, 70, 60, 50, 50, 50]


# --- recall, explanation, matching ---------------------------------------------------------------

def test_recall(spark):
    hits = spark.createDataFrame([(1, j, i + 1, 1.0) for i, j in enumerate("abcde")], LIST)
    gold = spark.createDataFrame([(1, j) for j in "acef"], "query_id long, job_id string")
    queries = spark.createDataFrame([(1,), (2,)], "query_id long")
    rows = {r.query_id: r for r in evaluate.recall_at(hits, gold, queries, [3, 5, None]).collect()}
    assert (rows[1].recall_at_3, rows[1].recall_at_5, rows[1].recall_all, rows[1].retrieved_count) == (0.5, 0.75, 0.75, 5)
    assert (rows[2].recall_at_3, rows[2].retrieved_count) == (1.0, 0)


def postings_of(spark, rows):
    return spark.createDataFrame(rows, "id long, title string, company string, url string, category string, skills_required array<string>, skills_nice_to_have array<string>")


def test_explanation(spark):
    p = postings_of(spark, [(i, "Dev", "Acme", "u", "Backend", ["Python", "Kafka"], ["Docker", "AWS"]) for i in range(5)])
    mine = spark.createDataFrame([(7, "Python"), (7, " docker ")], "resume_id long, skill string")
    scores = skills.category_scores(p, mine)
    assert scores.first().match_score == 50
    hits = spark.createDataFrame([(7, 1, 1, 0.5, True, False)], "resume_id long, rank long, job_id long, score double, from_keyword boolean, from_semantic boolean")
    r = recommend.explain(recommend.hydrate(hits, p), mine, scores).first()
    assert (r.matched_skills, r.missing_skills, r.retrieval_reason, r.category_score) == (["Python", "Docker"], ["Kafka", "AWS"], "keyword_match", 50)
    assert r.summary == "Matched 2 resume skills"


def test_small_categories_stay_unless_asked(spark):
    p = postings_of(spark, [(i, "Dev", "Acme", "u", " QA ", [], None) for i in range(5)] + [(9, "Dev", "Acme", "u", "Rare", ["Python"], [])])
    mine = spark.createDataFrame([(7, "Python")], "resume_id long, skill string")
    rows = skills.category_scores(p, mine).collect()
    assert [(r.category, r.match_score, [s.skill for s in r.matching_skills]) for r in rows] == [("Rare", 100, ["Python"])]
    assert skills.category_scores(p, mine, min_jobs=5).count() == 0
    asked = spark.createDataFrame([(7, "QA"), (7, "Rare"), (8, "Rare")], "resume_id long, category string")
    assert {tuple(r) for r in skills.scores_of(asked, skills.category_scores(p, mine)).collect()} == {(7, "QA", 0), (7, "Rare", 100), (8, "Rare", 0)}


def test_missing_skills_of_shared_categories(spark):
    jobs = [(i, "t", "c", "u", "A", [w for k, w in enumerate("abcdefgh") if i % (k + 1) == 0], []) for i in range(40)]
    jobs += [(100, "t", "c", "u", "B", ["z", "a"], []), (101, "t", "c", "u", "C", ["y"], [])]
    mine = spark.createDataFrame([(1, "a"), (1, "C"), (2, "h"), (3, "z"), (3, "nothing")], "resume_id long, skill string")
    p = postings_of(spark, jobs)
    got = {}
    for r in skills.skills_to_add(p, mine).orderBy("position").collect():
        got.setdefault((r.resume_id, r.category), []).append(r.skill)
    assert got == {(1, "A"): list("bdefgh"), (1, "B"): ["z"], (2, "A"): list("abcdefg"), (3, "B"): ["a"]}
    cut = {}
    for r in skills.skills_to_add(p, mine, limit=2).orderBy("position").collect():
        cut.setdefault((r.resume_id, r.category), []).append(r.skill)
    assert cut == {k: v[:2] for k, v in got.items()}


@pytest.mark.parametrize("limit", [1, 3, 50])
def test_matching_equals_brute_force(spark, limit):
    import random

    random.seed(limit)
    words = ["Python", "python", " SQL ", "Go", "Rust", "C++", "", "Java"]
    pick = lambda n: [random.choice(words) for _ in range(random.randint(0, n))]
    jobs = [(i, "t", "c", "u", "x", pick(3), pick(2) or None) for i in range(120)]
    people = {r: [w for w in pick(4)] for r in range(15)}
    people[99] = [""]
    norm = lambda s: s.strip().lower()
    want = set()
    for r, mine in people.items():
        target = {norm(s) for s in mine if s.strip()}
        scored = []
        for i, *_, req, nice in jobs:
            raw = req + (nice or [])
            both = target & {norm(s) for s in raw if s.strip()}
            if both:
                shown = {norm(s): s for s in raw if s}
                scored.append((-len(both), i, tuple(sorted(shown[m] for m in both))))
        for rank, (c, i, shown) in enumerate(sorted(scored)[:limit], 1):
            want.add((r, rank, i, -c, round(-c / len(target), 9), shown))
    mine = spark.createDataFrame([(r, s) for r, ss in people.items() for s in ss], "resume_id long, skill string")
    got = {(r.resume_id, r["rank"], r.job_id, r.match_count, round(r.match_ratio, 9), tuple(r.matched_skills))
           for r in skills.match_postings(postings_of(spark, jobs), mine, limit=limit).collect()}
    assert got == want


def test_hits_with_valid_ids(spark):
    hits = spark.createDataFrame([("123e4567-e89b-12d3-a456-426614174000",), ("x",), (None,)], "job_id string")
    assert recommend.valid_hits(hits).count() == 1


def test_embedding_failures_stay_keyed(spark):
    texts = spark.createDataFrame([(1, "python dev"), (2, " "), (3, "python dev"), (4, "bad")], "job_id long, text string")

    def fn(batch):
        return [None if t == "bad" else np.ones(4 if "dev" in t else 3) for t in batch]

    rows = {r.job_id: r for r in embed.embed_texts(texts, dims=4, embed_fn=fn).collect()}
    assert {k: r.ok for k, r in rows.items()} == {1: True, 2: False, 3: True, 4: False}
    assert rows[1].content_key == rows[3].content_key and rows[1].embedding == [1.0] * 4 and rows[4].embedding is None


def test_vocabulary_is_made_distinct_without_its_documents(spark):
    docs = spark.createDataFrame([(1, "go go rust", "sql"), (2, "rust", None), (1, "go", "sql")], "job_id int, title string, description string")
    index = search.build_index(docs, {"title": 2.0, "description": 1.0})
    want = {(r.field, r.term) for r in index.frequencies.collect()}
    assert {tuple(r) for r in index.vocabulary.collect()} == want == {("title", "go"), ("title", "rust"), ("description", "sql")}
    assert len(index.vocabulary.collect()) == 3
    assert "Aggregate [job_id" not in index.vocabulary._jdf.queryExecution().optimizedPlan().toString()


def test_kept_rows_come_back_as_they_were(spark):
    from jobweave.session import ensure_checkpoint_dir, keep

    rows = spark.createDataFrame([(1, "a", ["x"]), (None, None, None)], "k long, t string, s array<string>")
    kept = keep(rows)
    assert sorted(map(str, kept.collect())) == sorted(map(str, rows.collect())) and kept.schema == rows.schema
    assert keep(rows.where("k = 7")).count() == 0
    assert all(f.startswith(ensure_checkpoint_dir(spark)) or f.startswith("file:") for f in kept.inputFiles())


def test_fuzzy_search_keeps_postings_where_texts_are_read(spark, monkeypatch):
    """No count of a document and no pair of document and query is written or shuffled, also where terms are too many for a
    matrix; ids that come twice, lengths that differ and ties included the hits are those of joining every pair."""
    import random

    r = random.Random(5)
    word = lambda: "".join(r.choice("abc") for _ in range(r.randint(2, 6)))
    rows = [(i if i % 7 else i // 2, " ".join(word() for _ in range(r.randint(0, 6))), r.choice(["aab", "acme"]), "", " ".join(["abca"] * (i % 4))) for i in range(120)]
    frame = spark.createDataFrame(rows, "job_id long, title string, company string, skills_combined string, description string")
    index = search.build_index(frame, {"title": 2.0, "company": 1.0, "description": 1.0})
    queries = spark.createDataFrame([(q, f"{word()} {word()} abca" if q else "aab") for q in range(9)], "query_id long, query_text string")
    terms = search.expand_fuzzy(search._query_terms(queries, index, "query_id", "query_text"), index)
    found, weighted = search.weigh(index, terms)
    want = [tuple(x) for x in search.top_k_per_query(search._best_field(found.join(weighted, ["field", "term"]), 9), 5).collect()]

    written = []
    monkeypatch.setattr(search, "WEIGHTS", 1)
    monkeypatch.setattr(search, "PRODUCTS", 64)  # several stretches of documents in a task
    monkeypatch.setattr(search, "keep", lambda df: (written.append(df.columns), keep(df))[1])
    keep = __import__("jobweave.session", fromlist=["keep"]).keep
    for refused in ("_best_field", "score_candidates", "weigh"):
        monkeypatch.setattr(search, refused, None)
    got = [tuple(x) for x in search.search_keyword(index, queries, top_k=5, fuzzy=True).collect()]
    assert sorted(got) == sorted(want) and len({q for q, *_ in got}) == 9
    assert written and not any("job_id" in columns for columns in written)


def test_fuzzy_candidates_are_compared_once(spark):
    """Terms that many queries ask in several fields, and that only share letters elsewhere, bring no pairs of their own."""
    docs = spark.createDataFrame([(1, "cat", "", "", "tac xxca"), (2, "cut", "", "", "cat")], "job_id long, title string, company string, skills_combined string, description string")
    index = search.build_index(docs, {"title": 1.0, "description": 1.0})
    terms = spark.createDataFrame([(q, f, "cat", 1) for q in range(3) for f in ("title", "description")], "query_id int, field string, term string, n long")
    got = {(r.query_id, r.field, r.term, round(r.n, 6)) for r in search.expand_fuzzy(terms, index).collect()}
    assert {(t, n) for _, _, t, n in got} == {("cat", 1.0), ("cut", round(2 / 3, 6))} and len(got) == 12
