"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from jobweave.llm.shared import WORD, fingerprint, small_side, stash

MAX_TIMES = 3
BINS = 1 << 12


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def cyclic_weights(sources: DataFrame, cycle: int = 3) -> DataFrame:
    """(source, weight): 1, 2, ... ``cycle``, repeating, by code point of the source, null last.

    One row per source goes through one task here; documents do not.
    """
    order = W.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    return sources.select("source", ((F.row_number().over(order) - 1) % cycle + 1).alias("weight"))


def source_targets(sizes: DataFrame, weights: DataFrame, share: float = 1.0, max_times: int = MAX_TIMES) -> DataFrame:
    """(source, source_size, target): ``share`` of all sizes by weight, at most ``max_times`` a source's size.

    Sources are taken by rising cap over weight.  Given that all before it are capped, a
    source is capped too when the rest, shared by weight, would give it more than its cap;
    the first for which that fails, and all after it, share the rest.  This is where sharing
    the excess again and again ends.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = per.withColumnRenamed("source", "_s").join(weights, F.col("_s").eqNullSafe(F.col("source"))).drop("_s")
    per = per.withColumn("_cap", (max_times * F.col("source_size")).cast("double"))
    order = W.orderBy(F.col("_cap") / F.col("weight"), F.col("source").isNull(), F.encode("source", "UTF-8"))
    before, after, all_rows = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing), W.partitionBy(F.lit(0))
    per = per.withColumns({
        "_total": share * F.sum("source_size").over(all_rows),
        "_used": F.coalesce(F.sum("_cap").over(before), F.lit(0.0)),
        "_weights": F.sum("weight").over(after).cast("double"),
    })
    per = per.withColumn("_level", (F.col("_total") - F.col("_used")) / F.col("_weights"))
    per = per.withColumn("_fits", F.col("_level") * F.col("weight") <= F.col("_cap"))
    level = F.min(F.when(F.col("_fits"), F.struct(F.col("_cap") / F.col("weight"), F.col("_level").alias("level")))).over(all_rows)["level"]
    target = F.when(level.isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), level * F.col("weight")))
    return per.select("source", "source_size", target.alias("target"))


def uniform(*cols: str | Column, seed: int = 0) -> Column:
    """A number in (0, 1) that depends on the values only: 52 bits of an MD5 digest."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("null")) for c in cols])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def pareto_sample(items: DataFrame, group: str, size: str, copies: str, rank: Column, tie: list[str]) -> DataFrame:
    """``items`` with ``times``: how often each is taken, for expected copies ``copies`` per item.

    Every item first gets floor(copies) certain whole copies.  For the fraction p left over, the
    item's order is its random odds u/(1-u) over its inclusion odds p/(1-p); in each group
    items are taken in rising order as long as the sum of sizes comes nearer to the sum of
    p * size, rounded so that no order of summing shows, which fixes the size of the sample.  Items with p = 0 never are.

    The order is cut into BINS bins by its value.  Sums per (group, bin) are small; only
    the one bin per group that holds the cut is sorted, so no task sees a whole group.  ``items``
    are read for the sums, the bins and the result, so they should be stored or cheap to make.
    """
    whole = F.floor(copies).cast("long")
    p = F.col(copies) - whole
    u = rank
    df = items.withColumn("_whole", whole).withColumn("_p", p)
    df = df.withColumn("_order", F.when(F.col("_p") > 0, (u / (1 - u)) / (F.col("_p") / (1 - F.col("_p")))))
    # order/(1+order) lies in (0, 1) and keeps the order of the items.
    df = df.withColumn("_bin", F.floor(F.col("_order") / (1 + F.col("_order")) * BINS).cast("int"))
    sums = df.groupBy(group).agg(F.round(F.sum(F.col("_p") * F.col(size)), 6).alias("_goal"))
    bins = df.where(F.col("_bin").isNotNull()).groupBy(group, "_bin").agg(F.sum(size).alias("_size"))
    running = F.sum("_size").over(W.partitionBy(group).orderBy("_bin").rowsBetween(W.unboundedPreceding, -1))
    bins = bins.withColumn("_before", F.coalesce(running, F.lit(0))).withColumnRenamed(group, "_g")
    bins = bins.join(sums.withColumnRenamed(group, "_g2"), F.col("_g").eqNullSafe(F.col("_g2"))).drop("_g2")
    cut = bins.where((F.col("_before") <= F.col("_goal")) & (F.col("_before") + F.col("_size") > F.col("_goal")))
    cut = cut.groupBy("_g").agg(F.min_by(F.struct(F.col("_bin").alias("bin"), "_before", "_goal"), "_bin").alias("_cut"))
    cut = small_side(stash(cut, "pareto_cuts"))
    rows = df.join(cut, F.col(group).eqNullSafe(F.col("_g")), "left").drop("_g")
    # Without a cut the goal is at or beyond the sum of all: everything with p > 0 is taken.
    sure = rows.where(F.col("_bin").isNull() | F.col("_cut").isNull() | (F.col("_bin") != F.col("_cut.bin"))).withColumn(
        "_taken", F.col("_bin").isNotNull() & (F.col("_cut").isNull() | (F.col("_bin") < F.col("_cut.bin"))))
    near = rows.where(F.col("_bin") == F.col("_cut.bin"))
    upto = F.sum(size).over(W.partitionBy(group).orderBy("_order", *tie).rowsBetween(W.unboundedPreceding, 0))
    near = near.withColumn("_upto", F.col("_cut._before") + upto)
    # Taken while the middle of the item lies before the goal: the sum ends as near as it can.
    near = near.withColumn("_taken", F.col("_upto") - F.col(size) / 2 <= F.col("_cut._goal")).drop("_upto")
    out = sure.unionByName(near)
    return out.select(*items.columns, (F.col("_whole") + F.col("_taken").cast("long")).alias("times"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: DataFrame | None = None,
        seed: int = 0) -> DataFrame:
    """(key, _h1, _h2, source, size, source_size, target, times, taken) of every document.

    Copies expected of a document are its source's target over its source's size.  The random
    number of a document depends on key, text and seed, so reruns agree, and repeated rows share
    it.  A null text has size 0; documents of size 0 take nothing from a target but may be taken.
    Sources without any word have target 0.  ``weights`` has (source, weight), by default the
    cyclic ones.  ``_h1`` and ``_h2`` are the fingerprint of the text, which with the key names the row.
    """
    sizes = docs.select(F.col(key).alias("_key"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"),
                        F.md5(F.coalesce(F.col(text), F.lit(""))).alias("_md5"), *fingerprint(text))
    sizes = stash(sizes, "mix_sizes")
    weights = cyclic_weights(sizes.select("source").distinct()) if weights is None else weights
    targets = small_side(stash(source_targets(sizes, weights), "mix_targets"))
    rows = sizes.join(targets.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    rows = rows.withColumn("copies", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    rows = rows.withColumn("_u", uniform("_key", "_md5", seed=seed))
    taken = pareto_sample(rows, "source", "size", "copies", F.col("_u"), ["_key", "_md5"])
    return taken.select(F.col("_key").alias(key), "_h1", "_h2", "source", "size", "source_size", "target", "times",
                        (F.col("times") * F.col("size")).alias("taken"))
