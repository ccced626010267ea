"""Blocks of one table against blocks of another, two of bounded size at a time."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobweave.operators.skew import task_count


@dataclass(frozen=True)
class Grid:
    """Number of blocks on each side, and of tasks for the cells that they span."""

    left: int
    right: int
    tasks: int

    @classmethod
    def over(cls, left_rows: int, right_rows: int, block_rows: int, tasks: int, least: int = 512) -> Grid:
        """Blocks of ``block_rows`` rows on average; small tables are cut finer, down to ``least`` rows,
        to give every task work.

        A row goes to all blocks of the other side, and each cell has results for all its rows of ``left``; so both
        sides are cut in proportion to their rows, which moves least for a number of cells.
        """
        finest = lambda rows: -(-rows // least)
        even = math.isqrt(2 * tasks * left_rows // max(right_rows, 1))
        of_left = max(1, -(-left_rows // block_rows), min(finest(left_rows), even))
        of_right = max(1, -(-right_rows // block_rows), min(finest(right_rows), -(-2 * tasks // of_left)))
        return cls(of_left, of_right, min(of_left * of_right, 4 * tasks))


def grid_of(left: DataFrame, right: DataFrame, block_rows: int) -> Grid:
    """A grid for both tables, which are counted."""
    return Grid.over(left.count(), right.count(), block_rows, task_count(right))


def meet_blocks(
    left: DataFrame, right: DataFrame, by: tuple[Column, Column], grid: Grid,
    work: Callable[[pa.Table, pa.Table], pa.Table], schema: T.StructType,
) -> DataFrame:
    """What ``work`` makes of every block of ``left`` with every block of ``right``.

    ``by`` holds a 64-bit hash of each side that deals its rows to blocks; rows that are equal in
    it share a block.  Every row goes to one block and from there to all cells of that block,
    within one plan and without the driver; a task holds one cell at a time.
    """
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = left.withColumn("_i", F.pmod(by[0], F.lit(grid.left)).cast("int")).withColumn("_j", every(grid.right))
    b = right.withColumn("_j", F.pmod(by[1], F.lit(grid.right)).cast("int")).withColumn("_i", every(grid.left))
    return cogroup_cells(a, b, ["_i", "_j"], grid.tasks, work, schema)


def cogroup_cells(
    left: DataFrame, right: DataFrame, cell: list[str], tasks: int,
    work: Callable[[pa.Table, pa.Table], pa.Table], schema: T.StructType,
) -> DataFrame:
    """``work`` on the rows of both sides that share a cell; cells with rows of one side only are passed over."""
    def run(_: tuple, x: pa.Table, y: pa.Table) -> pa.Table:
        if not x.num_rows or not y.num_rows:
            return empty
        return work(x, y)

    from pyspark.sql.pandas.types import to_arrow_schema

    empty = to_arrow_schema(schema).empty_table()
    # Under new names for their columns two sides made from one table stay apart.
    sides = [side.toDF(*side.columns).repartition(tasks, *cell).groupBy(*cell) for side in (left, right)]
    return sides[0].cogroup(sides[1]).applyInArrow(run, schema)


def best_columns(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k largest scores of each row; of equal ones the first columns."""
    if scores.shape[1] <= k:
        return np.divmod(np.arange(scores.size), max(scores.shape[1], 1))
    last = np.partition(scores, -k, axis=1)[:, -k][:, None]
    above, equal = scores > last, scores == last
    room = k - above.sum(axis=1, keepdims=True)
    return np.nonzero(above | (equal & (np.cumsum(equal, axis=1) <= room)))
