"""Hard negatives of anchor vectors, with exact integer scores from a residue number system.

Components are integers.  Blocks of anchors meet blocks of rows: for each of several small primes
the two component matrices are multiplied modulo the prime, in 32-bit floats whose sums stay
below 2^24 and so are exact, and Chinese remaindering gives the signed score.  A first pass finds
the positives of every anchor, a second one the best negatives in the window of each positive.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from jobweave.llm.shared import stash
from jobweave.operators.skew import task_count

LARGEST_NORM = 1 << 56  # of a row's squared length, so that scores and their hundredfold fit 64 bits
LARGEST_PRIME = 256
BLOCK_NUMBERS = 1 << 22  # components in a block of anchors or rows
SCORES_AT_ONCE = 1 << 21
NOTHING = np.iinfo(np.int64).min


@dataclass(frozen=True)
class Window:
    """How many positives and negatives, and which share of the positive's score, in percent, a negative may have."""

    positives: int = 5
    negatives: int = 3
    low: int = 50
    high: int = 95


def primes_for(bound: int) -> list[int]:
    """Primes below LARGEST_PRIME, from the largest down, whose product exceeds the range from -bound to bound."""
    found, product = [], 1
    for n in range(LARGEST_PRIME - 1, 2, -1):
        if product > 2 * bound + 1:
            break
        if all(n % d for d in range(2, int(n**0.5) + 1)):
            found.append(n)
            product *= n
    if product <= 2 * bound + 1:
        raise ValueError("scores are too large")
    return found


class Residues:
    """Rows of integers as centred residues modulo each prime, in 32-bit floats."""

    def __init__(self, rows: np.ndarray, primes: list[int]):
        self.parts = [(((rows + p // 2) % p) - p // 2).astype(np.float32) for p in primes]


def exact_scores(left: Residues, right: Residues, rows: slice, primes: list[int]) -> np.ndarray:
    """Inner products of some rows of ``left`` with all of ``right``, as 64-bit integers.

    Mixed-radix digits are found prime by prime; the upper half of the range stands for
    negative scores.
    """
    dims = left.parts[0].shape[1]
    total, base = np.int64(0), 1
    for p, a, b in zip(primes, left.parts, right.parts):
        step = (1 << 24) // (p // 2) ** 2  # so many products of residues add up exactly
        residue = np.zeros((a[rows].shape[0], b.shape[0]), np.int64)
        for at in range(0, dims, step):
            residue += (a[rows, at:at + step] @ b[:, at:at + step].T).astype(np.int64)
        digit = (residue - total) % p * pow(base, -1, p) % p
        total = total + base * digit
        base *= p
    return np.where(total > base // 2, total - base, total)


def integer_rows(rows: DataFrame, key: str, vector: str, label: str, scale: int = 256) -> DataFrame:
    """(id, label, v array<int>, dims, norm, row): different rows that take part, v = floor(scale * x).

    Rows without id, label or vector, or with a component that is null or not finite, take no part,
    nor do those whose squared length in integers exceeds LARGEST_NORM.  Rows that are equal
    throughout count as one.
    """
    v = F.transform(F.col(f"`{vector}`"), lambda x: F.floor(x.cast("double") * scale))
    finite = F.forall(F.col(f"`{vector}`"), lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    length = F.aggregate(F.col(f"`{vector}`"), F.lit(0.0), lambda s, x: s + F.pow(F.floor(x.cast("double") * scale).cast("double"), F.lit(2.0)))
    kept = rows.where(F.col(f"`{key}`").isNotNull() & F.col(f"`{label}`").isNotNull() & finite & (length <= float(LARGEST_NORM)))
    return kept.select(
        F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{label}`").cast("long").alias("label"), v.cast("array<int>").alias("v"),
        F.size(F.col(f"`{vector}`")).alias("dims"), length.alias("norm"),
    ).dropDuplicates(["id", "label", "v"]).withColumn("row", F.xxhash64("id", "label", "v"))


@dataclass(frozen=True)
class Grid:
    """Blocks of anchors and of rows; every anchor block meets every row block in a cell of its own."""

    anchors: int
    rows: int
    tasks: int

    @classmethod
    def over(cls, anchors: int, rows: int, dims: int, tasks: int) -> Grid:
        """Blocks hold BLOCK_NUMBERS components on average; small tables are cut finer, to give every task work."""
        size = max(256, BLOCK_NUMBERS // max(dims, 1))
        of_anchors = max(1, -(-anchors // size))
        of_rows = max(1, -(-rows // size), min(-(-rows // 512), -(-2 * tasks // of_anchors)))
        return cls(of_anchors, of_rows, min(of_anchors * of_rows, 4 * tasks))


def _matrix(lists: pa.ChunkedArray, dims: int) -> np.ndarray:
    return pc.list_flatten(lists).to_numpy().astype(np.int64).reshape(len(lists), dims)


def _blocks(left: pa.Table, right: pa.Table, primes: list[int]) -> Iterator[tuple[slice, np.ndarray, pa.Table]]:
    """(some anchors, their scores with all rows, the rows by rising id) of a cell."""
    dims = left.column("dims")[0].as_py()
    right = right.sort_by("id")
    a, b = Residues(_matrix(left.column("v"), dims), primes), Residues(_matrix(right.column("v"), dims), primes)
    step = max(1, SCORES_AT_ONCE // right.num_rows)
    for at in range(0, left.num_rows, step):
        part = slice(at, min(at + step, left.num_rows))
        yield part, exact_scores(a, b, part, primes), right


def _best(scores: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(line, column, score) of the largest scores of each line, the first column first among equals; uses up ``scores``."""
    lines = np.arange(len(scores))
    for _ in range(min(most, scores.shape[1])):
        best = scores.argmax(axis=1)
        got = scores[lines, best]
        there = got != NOTHING
        yield lines[there], best[there], got[there]
        scores[lines, best] = NOTHING


def _positives(left: pa.Table, right: pa.Table, primes: list[int], window: Window) -> Iterator[dict]:
    ids, rows, labels = (left.column(c).to_numpy() for c in ("id", "row", "label"))
    for part, scores, right in _blocks(left, right, primes):
        other_ids, other_labels = right.column("id").to_numpy(), right.column("label").to_numpy()
        fits = (labels[part, None] == other_labels) & (ids[part, None] != other_ids)
        for line, at, score in _best(np.where(fits, scores, NOTHING), window.positives):
            yield {"anchor_id": ids[part][line], "row": rows[part][line], "other_id": other_ids[at], "score": score}


def _negatives(left: pa.Table, right: pa.Table, primes: list[int], window: Window) -> Iterator[dict]:
    ids, rows, labels = (left.column(c).to_numpy() for c in ("id", "row", "label"))
    listed = pc.list_value_length(left.column("bars")).to_numpy()
    bars = np.zeros((left.num_rows, window.positives), np.int64)
    has = np.arange(window.positives) < listed[:, None]
    bars[has] = pc.list_flatten(left.column("bars")).to_numpy()
    for part, scores, right in _blocks(left, right, primes):
        other_ids, other_labels = right.column("id").to_numpy(), right.column("label").to_numpy()
        scores = np.where(labels[part, None] != other_labels, scores, NOTHING)
        for k in range(window.positives):
            some = np.flatnonzero(has[part, k])
            bar = bars[part][some, k]
            low, high = -(-bar * window.low // 100), bar * window.high // 100
            inside = scores[some]
            inside[(inside < low[:, None]) | (inside > high[:, None])] = NOTHING
            for line, at, score in _best(inside, window.negatives):
                yield {"anchor_id": ids[part][some][line], "row": rows[part][some][line], "bar": bar[line], "other_id": other_ids[at], "score": score}


def _in_cell(key: tuple, left: pa.Table, right: pa.Table, pick: Callable, primes: list[int], window: Window, names: list[str]) -> pa.Table:
    found = list(pick(left, right, primes, window)) if left.num_rows and right.num_rows else []
    return pa.table({n: pa.array(np.concatenate([f[n] for f in found]) if found else np.empty(0, np.int64), pa.int64()) for n in names})


def _meet(anchors: DataFrame, rows: DataFrame, grid: Grid, pick: Callable, primes: list[int], window: Window, names: list[str]) -> DataFrame:
    """What ``pick`` finds in every cell of the grid.

    An anchor goes to one block and from there to all row blocks, a row likewise; a cell is two
    blocks of bounded size.
    """
    cell = ["dims", "_i", "_j"]
    whole = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = anchors.withColumn("_i", F.pmod(F.col("row"), F.lit(grid.anchors)).cast("int")).withColumn("_j", whole(grid.rows))
    right = rows.withColumn("_j", F.pmod(F.col("row"), F.lit(grid.rows)).cast("int")).withColumn("_i", whole(grid.anchors))
    # Both sides come from one table: under new names for its columns they stay apart.
    left, right = (side.toDF(*side.columns).repartition(grid.tasks, *cell).groupBy(*cell) for side in (left, right))
    work = partial(_in_cell, pick=pick, primes=primes, window=window, names=names)
    return left.cogroup(right).applyInArrow(lambda key, a, b: work(key, a, b), ", ".join(f"{n} long" for n in names))


def mine(rows: DataFrame, is_anchor: Column, key: str, vector: str, label: str, window: Window = Window()) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of all anchors.

    Scores are inner products of floor(256 * x); rows of different lengths are never compared.
    An anchor's positives are the best other ids of its label; for each of them the best rows of
    another label whose score lies in the window.  Equal scores are ordered by id.  ``is_anchor`` is a condition
    on the id column, named ``id``.  What takes part, and what repeated rows count, is said at
    ``integer_rows``.  Where several different rows share an id each is a row of its own, and each an anchor.
    An anchor without positives, or a positive without negatives, gives no rows; neither does an empty table.
    """
    table = stash(integer_rows(rows, key, vector, label), "vectors")
    size = table.agg(
        F.count(F.lit(1)).alias("rows"), F.count(F.when(is_anchor, 1)).alias("anchors"), F.max("dims").alias("dims"), F.max("norm").alias("norm")).first()
    primes = primes_for(int(size.norm or 0))
    grid = Grid.over(size.anchors, size.rows, size.dims or 0, task_count(table))
    anchors, others = table.where(is_anchor), table.select("id", "label", "v", "dims", "row")

    found = _meet(anchors, others, grid, _positives, primes, window, ["anchor_id", "row", "other_id", "score"])
    best = W.partitionBy("anchor_id", "row").orderBy(F.desc("score"), "other_id")
    positives = stash(found.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= window.positives), "positives")

    bars = positives.groupBy("row").agg(F.array_sort(F.collect_set("score")).alias("bars"))
    asking = anchors.join(bars, "row").select("id", "label", "v", "dims", "row", "bars")
    found = _meet(asking, others, grid, _negatives, primes, window, ["anchor_id", "row", "bar", "other_id", "score"])
    best = W.partitionBy("anchor_id", "row", "bar").orderBy(F.desc("score"), "other_id")
    negatives = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= window.negatives)
    asked = positives.select("anchor_id", "row", F.col("score").alias("bar"), F.col("other_id").alias("positive_id"))
    return negatives.join(asked, ["anchor_id", "row", "bar"]).select(
        "anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"), F.col("bar").alias("positive_score"), F.col("score").alias("negative_score"))
