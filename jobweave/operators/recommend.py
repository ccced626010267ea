"""Hits to postings, hybrid retrieval over query variants, fallback and explanation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobweave import fixed_values as fv
from jobweave.functions.text import all_skills, norm_skill, strip, strings_or_empty
from jobweave.operators.fusion import rerank, rrf_multi, rrf_pair
from jobweave.operators.search import TermIndex, search_keyword
from jobweave.operators.skew import broadcast_if_small
from jobweave.operators.vectors import VectorIndex, search_knn
from jobweave.session import cut_lineage

_UUID = r"(?i)^[{]?[0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12}[}]?$"
HIT_COLUMNS = ["title", "company", "url", "category"]


def valid_hits(hits: DataFrame) -> DataFrame:
    """Hits with an id in UUID form."""
    return hits.where(F.col("job_id").isNotNull() & F.col("job_id").cast("string").rlike(_UUID))


def hydrate(hits: DataFrame, postings: DataFrame, keep_missing: bool = True, valid_only: bool = False) -> DataFrame:
    """Hits with their posting's columns.

    ``keep_missing``: a hit whose posting is gone keeps the fields stored in the index (if
    the hits carry them); otherwise it is dropped.  ``valid_only`` first drops hits whose id is no
    UUID, for tables keyed by one.
    """
    hits = valid_hits(hits) if valid_only else hits
    chosen = postings.select(
        F.col("id").alias("job_id"), *[F.col(c).alias(f"_p_{c}") for c in HIT_COLUMNS],
        strings_or_empty(F.col("skills_required")).alias("skills_required"),
        strings_or_empty(F.col("skills_nice_to_have")).alias("skills_nice_to_have"),
        F.lit(True).alias("in_table"),
    )
    # Reduce the table to the hit ids first; hits are few against postings.
    wanted = broadcast_if_small(hits.select("job_id").distinct())
    joined = hits.join(chosen.join(wanted, "job_id", "left_semi"), "job_id", "left" if keep_missing else "inner")
    have = set(hits.columns)
    rest = [c for c in hits.columns if c not in HIT_COLUMNS]
    return joined.select(
        *rest,
        *[F.coalesce(F.col(f"_p_{c}"), F.col(c) if c in have else F.lit(None)).alias(c) if keep_missing
          else F.col(f"_p_{c}").alias(c) for c in HIT_COLUMNS],
        strings_or_empty(F.col("skills_required")).alias("skills_required"),
        strings_or_empty(F.col("skills_nice_to_have")).alias("skills_nice_to_have"),
        F.coalesce("in_table", F.lit(False)).alias("in_table"),
    )


def semantic_matches(index: VectorIndex, queries: DataFrame, postings: DataFrame, top_k: int = 10) -> DataFrame:
    """Nearest postings with match_ratio = score; postings that are gone are dropped."""
    return hydrate(search_knn(index, queries, top_k=top_k), postings, keep_missing=False).withColumnRenamed(
        "score", "match_ratio"
    )


def search_hybrid(
    terms: TermIndex, vectors: VectorIndex, queries: DataFrame, *, top_k: int = 10, k: int = fv.RRF_K
) -> DataFrame:
    """Keyword and vector search, each 2 x top_k deep, fused and cut to top_k.

    ``queries``: query_id, query_text, embedding.  Without a vector a query yields nothing;
    with a blank text it is a plain vector search of depth top_k.
    """
    asked = queries.where(F.size("embedding") > 0)
    text = strip(F.coalesce("query_text", F.lit("")))
    keyword = search_keyword(terms, asked, top_k=2 * top_k)
    semantic = cut_lineage(search_knn(vectors, asked, top_k=2 * top_k))
    with_text = asked.where(text != "").select("query_id")
    fused = rrf_pair(keyword, semantic.join(broadcast_if_small(with_text), "query_id", "left_semi"), k=k, top_k=top_k)
    plain = rrf_pair(
        keyword.limit(0), semantic.join(broadcast_if_small(with_text), "query_id", "left_anti"), k=k, top_k=top_k
    )
    return fused.unionByName(plain)


def multi_query_retrieve(
    terms: TermIndex, vectors: VectorIndex, variants: DataFrame, documents: DataFrame | None = None, *,
    top_k: int = 10, reranking: bool = True, candidates: int = fv.RERANK_CANDIDATES, **rerank_options,
) -> DataFrame:
    """(resume_id, rank, job_id, score, from_keyword, from_semantic) over query variants.

    ``variants``: resume_id, variant (0 is the primary query), query_text, embedding.
    """
    depth = candidates if reranking else top_k
    named = variants.withColumn("query_id", F.struct("resume_id", "variant"))
    hits = cut_lineage(search_hybrid(terms, vectors, named, top_k=depth))
    lists = hits.select(
        F.col("query_id.resume_id").alias("query_id"), F.col("query_id.variant").alias("list_id"), "job_id", "rank", "score",
    )
    fused = rrf_multi(lists, top_k=depth)
    flags = hits.groupBy(F.col("query_id.resume_id").alias("query_id"), "job_id").agg(
        F.max("from_keyword").alias("from_keyword"), F.max("from_semantic").alias("from_semantic"),
        F.min("keyword_rank").alias("keyword_rank"), F.min("semantic_rank").alias("semantic_rank"),
    )
    joined = fused.join(flags, ["query_id", "job_id"])
    if reranking and documents is not None:
        primary = variants.where("variant = 0").select(F.col("resume_id").alias("query_id"), "query_text")
        # Lists of bounded size, which callers read more than once.
        joined = cut_lineage(rerank(cut_lineage(joined), primary, documents, top_k=top_k, **rerank_options))
    else:
        joined = joined.where(F.col("rank") <= top_k)
    return joined.withColumnRenamed("query_id", "resume_id")


def with_keyword_fallback(hybrid: DataFrame, terms: TermIndex, queries: DataFrame, top_k: int = 10) -> DataFrame:
    """Hybrid hits with status ok; queries that got none fall back to keyword search.

    Output: query_id, status, rank, job_id, score.  A query with neither is one row with
    status ``none``.
    """
    hybrid = cut_lineage(hybrid)
    ok = hybrid.select("query_id", F.lit("ok").alias("status"), "rank", "job_id", "score")
    open_queries = queries.join(hybrid.select("query_id").distinct(), "query_id", "left_anti")
    keyword = search_keyword(terms, open_queries, top_k=top_k)
    fallback = open_queries.select("query_id").join(keyword, "query_id", "left").select(
        "query_id", F.when(F.col("job_id").isNotNull(), "fallback").otherwise("none").alias("status"), "rank", "job_id", "score"
    )
    return ok.unionByName(fallback)


def explain(recommended: DataFrame, resume_skills: DataFrame, scores: DataFrame) -> DataFrame:
    """Why each recommendation is there.

    ``recommended``: resume_id, job_id, category, both skill lists, from_keyword,
    from_semantic.  Matched and missing skills keep the posting's order and repeats.
    """
    mine = resume_skills.select("resume_id", norm_skill(F.col("skill")).alias("n")).groupBy("resume_id").agg(
        F.collect_set("n").alias("_mine")
    )
    overlap = scores.select("resume_id", F.col("category").alias("_category"), F.col("match_score").alias("_score"))
    rows = (
        recommended.withColumn("_category", strip(F.coalesce("category", F.lit(""))))
        .join(mine, "resume_id", "left").join(overlap, ["resume_id", "_category"], "left")
    )
    listed = F.filter(all_skills(), lambda s: s.isNotNull() & (s != ""))
    known = strings_or_empty(F.col("_mine"))
    matched = F.filter(listed, lambda s: F.array_contains(known, norm_skill(s)))
    missing = F.filter(listed, lambda s: ~F.array_contains(known, norm_skill(s)))
    reason = (
        F.when(F.col("from_keyword") & F.col("from_semantic"), "hybrid_match")
        .when(F.col("from_keyword"), "keyword_match").when(F.col("from_semantic"), "semantic_match").otherwise("match")
    )
    told = rows.withColumns({"matched_skills": matched, "missing_skills": missing})
    return told.select(
        "resume_id", "rank", "job_id", "score", reason.alias("retrieval_reason"), "matched_skills", "missing_skills",
        F.col("_category").alias("category"), F.coalesce("_score", F.lit(0).cast("bigint")).alias("category_score"),
        F.when(F.size("matched_skills") > 0, F.format_string("Matched %d resume skills", F.size("matched_skills")))
        .otherwise("No direct skill match").alias("summary"),
    )
