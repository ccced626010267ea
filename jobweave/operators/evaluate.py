"""Recall of ranked lists against known answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobweave import fixed_values as fv


def recall_at(
    retrieved: DataFrame, gold: DataFrame, queries: DataFrame, cutoffs: list[int | None] | None = None
) -> DataFrame:
    """Per query: recall_at_<k> (recall_all for None), gold_count and retrieved_count.

    A query without any known answer has recall 1.
    """
    cutoffs = cutoffs or list(fv.RECALL_CUTOFFS)
    ranks = retrieved.where("job_id IS NOT NULL").groupBy("query_id", "job_id").agg(F.min("rank").alias("rank"))
    wanted = gold.select("query_id", "job_id").distinct()
    found = wanted.join(ranks, ["query_id", "job_id"], "left").groupBy("query_id").agg(
        F.count(F.lit(1)).alias("gold_count"),
        *[F.count_if((F.col("rank") <= k) if k is not None else F.col("rank").isNotNull()).alias(f"_{k}") for k in cutoffs],
    )
    listed = retrieved.where("job_id IS NOT NULL").groupBy("query_id").agg(F.count(F.lit(1)).alias("retrieved_count"))
    name = lambda k: "recall_all" if k is None else f"recall_at_{k}"
    return queries.select("query_id").distinct().join(found, "query_id", "left").join(listed, "query_id", "left").select(
        "query_id", F.coalesce("gold_count", F.lit(0).cast("bigint")).alias("gold_count"),
        F.coalesce("retrieved_count", F.lit(0).cast("bigint")).alias("retrieved_count"),
        *[F.coalesce(F.col(f"_{k}") / F.col("gold_count"), F.lit(1.0)).alias(name(k)) for k in cutoffs],
    )


def mean_recall(per_query: DataFrame) -> DataFrame:
    """Macro mean over the query set."""
    names = [c for c in per_query.columns if c.startswith("recall_")]
    return per_query.agg(
        F.count(F.lit(1)).alias("queries"), *[F.round(F.avg(c), 6).alias(c) for c in names],
        F.sum("retrieved_count").alias("retrieved_count"),
    )
