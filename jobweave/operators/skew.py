"""Helpers for joins in which one key, or one side, may be far larger than the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A hot key holds more than one in HOT_SHARE of all rows, and LEAST_HOT at least; so there are fewer than HOT_SHARE of them.
HOT_SHARE = 5_000
LEAST_HOT = 1_000
SPREAD = 256
BROADCAST_ROWS = 2_000_000
BROADCAST_BYTES = 64 * 1024 * 1024


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Measure ``df``: true when its rows and its text form stay below both limits."""
    row_bytes = F.octet_length(F.struct(*[F.col(f"`{c}`") for c in df.columns]).cast("string"))
    got = df.agg(F.count(F.lit(1)).alias("n"), F.sum(row_bytes).alias("b")).first()
    return got.n <= max_rows and (got.b or 0) <= max_bytes


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast after measuring; beyond the limits the join shuffles (adaptively)."""
    return F.broadcast(df) if fits_broadcast(df, max_rows, max_bytes) else df


def attach_by_key(
    rows: DataFrame,
    per_key: DataFrame,
    keys: list[str],
    frequency: str,
    spread_on: str,
    how: str = "left",
    frequencies: DataFrame | None = None,
) -> DataFrame:
    """Join the one-row-per-key table ``per_key`` to ``rows`` without a hot partition.

    Keys with more than one in HOT_SHARE of all rows (fewer than HOT_SHARE, so a safe broadcast)
    are marked on both sides: their rows get one of SPREAD salts, their entry of ``per_key`` is
    repeated once per salt.  All other keys join as they are.  A plain join would not be
    split at run time here, because the aggregated side is not a bare shuffle.

    ``frequencies`` (keys, frequency) names the counts where they come cheaper than from
    ``per_key`` itself.
    """
    values = [c for c in per_key.columns if c not in keys]
    counted = per_key if frequencies is None else frequencies
    total = counted.agg((F.sum(frequency) / HOT_SHARE).alias("_share")).withColumn("_one", F.lit(1))  # one row
    often = counted.where(F.col(frequency) >= LEAST_HOT).withColumn("_one", F.lit(1)).join(F.broadcast(total), "_one")
    hot = F.broadcast(
        often.where(F.col(frequency) > F.col("_share"))
        .select(*[F.col(k).alias(f"_h_{k}") for k in keys], F.lit(True).alias("_hot"))
    )

    def marked(df: DataFrame, salt: Column) -> DataFrame:
        on = [df[k].eqNullSafe(hot[f"_h_{k}"]) for k in keys]
        return df.join(hot, on, "left").withColumn("_salt", salt).drop("_hot", *[f"_h_{k}" for k in keys])

    is_hot = F.col("_hot").isNotNull()
    left = marked(rows, F.when(is_hot, F.pmod(F.xxhash64(spread_on), F.lit(SPREAD)).cast("int")).otherwise(0))
    salts = F.when(is_hot, F.sequence(F.lit(0), F.lit(SPREAD - 1))).otherwise(F.array(F.lit(0)))
    right = marked(per_key, F.explode(salts)).select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], *values, F.col("_salt").alias("_k_salt")
    )
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys] + [F.col("_salt") == F.col("_k_salt")]
    return left.join(right, on, how).select(*rows.columns, *values)


def rows_with_keys(big: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``big`` whose key is among ``keys``.

    For a small batch against a stored table: the batch's keys are measured and broadcast,
    so that the table is scanned but not shuffled; a large batch shuffles both.
    """
    return big.join(broadcast_if_small(keys.select(*on).distinct()), on, "left_semi")


def task_count(df: DataFrame) -> int:
    """Partitions for work whose cost is out of proportion to its input size, where run-time
    coalescing by bytes would leave too few tasks."""
    spark = df.sparkSession
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


TASK_ROWS = 8_192  # so many rows of costly work are enough for one task


def spread_if_few(df: DataFrame) -> DataFrame:
    """``df`` dealt anew where it was read in fewer tasks than there are cores, or in tasks of very many rows.

    For work per row that costs far more than reading it.  Row ids of partitions are counted, which reads no
    column.  The number of tasks grows with the rows, so that no task grows with the table, however few
    files or row groups it lies in.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    sizes = df.select(F.spark_partition_id().alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    got = sizes.agg(F.count(F.lit(1)).alias("tasks"), F.max("n").alias("most"), F.sum("n").alias("rows")).first()
    if got.tasks >= cores and got.most <= TASK_ROWS:
        return df
    # By a hash of the whole row: dealing in turn would first sort the rows of each task, texts and all, on disk.
    return df.repartition(max(task_count(df), -(-(got.rows or 0) // TASK_ROWS)), *df.columns)
