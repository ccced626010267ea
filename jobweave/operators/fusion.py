"""Reciprocal-rank fusion of ranked lists, and reranking."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobweave import fixed_values as fv
from jobweave.functions.numbers import half_up
from jobweave.functions.text import rerank_text, strip
from jobweave.operators.search import analyze

DIGITS = 12


def rrf_pair(keyword: DataFrame, semantic: DataFrame, *, k: int = fv.RRF_K, top_k: int | None = None) -> DataFrame:
    """Fuse a keyword and a vector list per query.

    A job missing from one list counts there with rank max(list lengths) + 1.  A query with
    only one list keeps that list's scores and order.  Output: query_id, rank, job_id,
    score, keyword_rank, semantic_rank, keyword_score, semantic_score, from_keyword,
    from_semantic.  The ranks shown for a job in both lists are its merged position, the
    list ranks stay in the ``*_list_rank`` columns.
    """
    legs = keyword.select("query_id", "job_id", "rank", "score", F.lit(0).alias("leg")).unionByName(
        semantic.select("query_id", "job_id", "rank", "score", F.lit(1).alias("leg"))
    )
    def side(leg: int, column: str, how: Callable) -> Column:
        return how(F.when(F.col("leg") == leg, F.col(column)))
    # A job listed twice in one list counts at its first rank.
    merged = legs.groupBy("query_id", "job_id").agg(
        side(0, "rank", F.min).alias("keyword_list_rank"), side(1, "rank", F.min).alias("semantic_list_rank"),
        F.min_by(F.when(F.col("leg") == 0, F.col("score")), F.when(F.col("leg") == 0, F.col("rank"))).alias("keyword_score"),
        F.min_by(F.when(F.col("leg") == 1, F.col("score")), F.when(F.col("leg") == 1, F.col("rank"))).alias("semantic_score"),
        F.sum(F.when(F.col("leg") == 0, 1).otherwise(0)).alias("_rows_a"), F.sum(F.when(F.col("leg") == 1, 1).otherwise(0)).alias("_rows_b"),
    )
    # Lists are cut to a fixed length before fusion, so a query's window is small.
    per_query = Window.partitionBy("query_id")
    len_a, len_b = F.sum("_rows_a").over(per_query), F.sum("_rows_b").over(per_query)
    sized = merged.withColumns({"_a": len_a, "_b": len_b})
    miss = F.greatest(F.col("_a"), F.col("_b"), F.lit(1)) + 1
    part = lambda c: F.lit(1.0) / (k + F.coalesce(F.col(c), miss))
    both_lists = (F.col("_a") > 0) & (F.col("_b") > 0)
    score = F.when(both_lists, F.round(part("keyword_list_rank") + part("semantic_list_rank"), DIGITS)).otherwise(
        F.coalesce("keyword_score", "semantic_score")
    )
    scored = sized.withColumns({
        "score": score, "_alone": F.when(both_lists, F.lit(0)).otherwise(F.coalesce("keyword_list_rank", "semantic_list_rank")),
        "from_keyword": F.col("keyword_list_rank").isNotNull(), "from_semantic": F.col("semantic_list_rank").isNotNull(),
    })
    order = Window.partitionBy("query_id").orderBy(F.asc("_alone"), F.desc("score"), F.asc("job_id"))
    ranked = scored.withColumn("rank", F.row_number().over(order).cast("bigint"))
    in_both = F.col("from_keyword") & F.col("from_semantic")
    out = ranked.select(
        "query_id", "rank", "job_id", "score",
        F.when(in_both, F.col("rank")).otherwise(F.col("keyword_list_rank")).alias("keyword_rank"),
        F.when(in_both, F.col("rank")).otherwise(F.col("semantic_list_rank")).alias("semantic_rank"),
        "keyword_list_rank", "semantic_list_rank", "keyword_score", "semantic_score", "from_keyword", "from_semantic",
    )
    return out if top_k is None else out.where(F.col("rank") <= top_k)


def rrf_multi(lists: DataFrame, *, k: int = fv.RRF_K, top_k: int | None = None) -> DataFrame:
    """Fuse any number of lists per query: rows (query_id, list_id, job_id, rank, score).

    score = sum of 1 / (k + rank); a missing list adds nothing and a repeat adds again.  A
    query with one list passes through unchanged.
    """
    fused = lists.groupBy("query_id", "job_id").agg(
        F.round(F.sum(F.lit(1.0) / (k + F.col("rank"))), DIGITS).alias("_rrf"),
        F.min(F.struct("list_id", "rank", "score")).alias("_first"),
        F.min("list_id").alias("_lo"), F.max("list_id").alias("_hi"),
    )
    per_query = Window.partitionBy("query_id")
    single = F.min("_lo").over(per_query) == F.max("_hi").over(per_query)
    scored = fused.withColumn("_single", single).withColumns({
        "score": F.when(F.col("_single"), F.col("_first.score")).otherwise(F.col("_rrf")),
        "_place": F.when(F.col("_single"), F.col("_first.rank")).otherwise(F.lit(0)),
    })
    order = Window.partitionBy("query_id").orderBy(F.asc("_place"), F.desc("score"), F.asc("job_id"))
    out = scored.withColumn("rank", F.row_number().over(order).cast("bigint")).select("query_id", "rank", "job_id", "score")
    return out if top_k is None else out.where(F.col("rank") <= top_k)


def overlap_score(query: Column, text: Column) -> Column:
    """Share of the query's distinct tokens that the text has; a stand-in pair scorer."""
    wanted = F.array_distinct(analyze(query))
    return F.when(F.size(wanted) > 0, F.size(F.array_intersect(wanted, F.array_distinct(analyze(text)))) / F.size(wanted)).otherwise(0.0)


def rerank(
    hits: DataFrame, queries: DataFrame, documents: DataFrame, *, top_k: int = 10,
    score_fn: Callable[[Column, Column], Column] | None = overlap_score, text_fn: Callable[[], Column] = rerank_text,
) -> DataFrame:
    """Order each query's hits by a pair score.

    ``score_fn`` takes the query and text columns; a pandas UDF around a model fits.  Without
    one, for a blank query, or where any hit of a query gets no score, the order stays.
    """
    from jobweave.operators.skew import broadcast_if_small

    if score_fn is None:
        return hits.where(F.col("rank") <= top_k)
    # Only texts of hits are put together.
    wanted = broadcast_if_small(hits.select("job_id").distinct())
    texts = documents.join(wanted, "job_id", "left_semi").select("job_id", text_fn().alias("_text"))
    asked = queries.select("query_id", strip(F.coalesce("query_text", F.lit(""))).alias("_q"))
    paired = texts.join(broadcast_if_small(hits), "job_id").join(broadcast_if_small(asked), "query_id").withColumn(
        "rerank_score", F.when(F.col("_q") != "", score_fn(F.col("_q"), F.col("_text")))
    )
    complete = F.count("rerank_score").over(Window.partitionBy("query_id")) == F.count(F.lit(1)).over(Window.partitionBy("query_id"))
    usable = paired.withColumn("_ok", complete).withColumn("_s", F.when(F.col("_ok"), F.col("rerank_score")))
    order = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("_s"), F.asc("rank"))
    placed = usable.withColumn("_new", F.row_number().over(order).cast("bigint")).where(F.col("_new") <= top_k)
    return placed.drop("rank", "_q", "_text", "_ok", "_s").withColumnRenamed("_new", "rank")


def relevance_percent(hits: DataFrame) -> DataFrame:
    """Min-max of the positive scores of a list as 0-100; equal scores fall by 10 to 50."""
    per_query = Window.partitionBy("query_id")
    positive = F.when(F.col("score") > 0, F.col("score"))
    low, high = F.coalesce(F.min(positive).over(per_query), F.lit(0.0)), F.coalesce(F.max(positive).over(per_query), F.lit(0.0))
    bounded = hits.withColumns({"_lo": low, "_hi": high})
    scaled = half_up((F.col("score") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * 100)
    spread = F.col("score").isNotNull() & (F.col("_hi") > F.col("_lo"))
    stepped = F.greatest(F.lit(50), F.lit(100) - (F.col("rank") - 1) * 10)
    return bounded.withColumn("relevance", F.when(spread, scaled).otherwise(stepped).cast("bigint")).drop("_lo", "_hi")
