"""What several operators need: the shared work folder, key columns, safe broadcasts."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobweave.operators.skew import broadcast_if_small
from jobweave.session import ensure_checkpoint_dir

# A word is a run of anything but the six ASCII white-space characters.
WORD = "[^\\x20\\x09-\\x0D]+"


_MADE: dict[str, list[str]] = {}  # folders made so far, by application


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (``spark.checkpoint.dir``)."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex[:12]}"
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(folder)
    return f"{folder}/{name}"


def clear_work(spark: SparkSession) -> int:
    """Delete the intermediate tables that operators of this application have written; how many folders that were.

    To be called once their results are written elsewhere: a result that is still to be computed reads them.
    """
    folders = _MADE.pop(spark.sparkContext.applicationId, [])
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in folders:
        at = jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(conf).delete(at, True)
    return len(folders)


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    The rows no longer depend on any executor, later jobs read them instead of computing them
    again, and a join of two stashed tables has bare shuffles on both sides, which adaptive
    execution can split where a key is hot.  The files live until ``clear_work``, or as long as checkpoints do.
    """
    path = work_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with its columns renamed to ``_c0``, ``_c1``, ..., and the new name of each, so that
    no column can clash with those an operator makes."""
    names = {c: f"_c{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fingerprint(*cols: Column | str) -> list[Column]:
    """Two independent 64-bit hashes, ``_h1`` and ``_h2``, that together stand for the values.

    Nulls count: each value is hashed with a flag, so that (null, 'a') and ('a', null) differ.
    """
    parts = [p for c in cols for c in [F.col(c) if isinstance(c, str) else c] for p in (c.isNull(), c)]
    return [F.xxhash64(*parts).alias("_h1"), F.xxhash64(F.lit(7), *parts).alias("_h2")]


def small_side(df: DataFrame) -> DataFrame:
    """``df``, a stashed table, with a broadcast hint if its measured size allows one."""
    return broadcast_if_small(df, max_rows=500_000, max_bytes=24 * 1024 * 1024)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only, whatever else the text holds."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def apply_times(docs: DataFrame, decisions: DataFrame, key: str = "doc_id", text: str = "text", once: bool = False) -> DataFrame:
    """Rows of ``docs``, each as often as ``decisions`` says, with the columns of ``docs``.

    ``decisions`` has one row per row of ``docs``: ``_key``, ``_h1``, ``_h2`` (the fingerprint of
    the text) and ``times``.  Rows that are equal in key and text share their times: their
    sum is the number of rows that stay, or with ``once`` their largest.  Only decisions other than "once" travel: by
    broadcast where their measured size allows, else in a join that adaptive execution can split.
    """
    total = F.max("times") if once else F.sum("times")
    odd = decisions.groupBy("_key", "_h1", "_h2").agg(total.cast("int").alias("_times"), F.count(F.lit(1)).alias("_rows"))
    odd = small_side(stash(odd.where(F.col("_times") != F.col("_rows")), "times"))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col(key).alias("_id"), *fingerprint(text))
    on = packed["_id"].eqNullSafe(odd["_key"]) & (packed["_h1"] == odd["_h1"]) & (packed["_h2"] == odd["_h2"])
    rows = packed.join(odd, on, "left").select("_doc", packed["_id"], packed["_h1"], packed["_h2"], "_times", "_rows")
    once = rows.where(F.coalesce(F.col("_rows") == 1, F.lit(True)))
    again = rows.where("_rows > 1 and _times > 0").dropDuplicates(["_id", "_h1", "_h2"])
    times = F.coalesce(F.col("_times"), F.lit(1))
    out = once.where(times > 0).unionByName(again).select("_doc", F.explode(F.array_repeat(F.lit(0), times)).alias("_copy"))
    return out.select("_doc.*")
