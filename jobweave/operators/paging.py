"""Any page of an ordered table: early pages as a top-k, deep ones through a directory of ranges."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobweave.operators.skew import task_count
from jobweave.session import ensure_checkpoint_dir

SHALLOW_ROWS = 10_000  # up to here a page is the end of a top-k of so many rows
RANGE = "_range"


class OrderDirectory:
    """A table in ranges of its order, each a partition, with the number of rows before each.

    Building it sorts the table once, in as many tasks as there are ranges; a page then reads the
    one or two ranges it lies in, wherever it is, and no task sees more than a range.
    """

    def __init__(self, rows: DataFrame, order: list[Column], starts: list[tuple[int, int, int]]):
        self.rows, self.order, self.starts = rows, order, starts

    @classmethod
    def build(cls, df: DataFrame, order: list[Column], root: str | None = None, ranges: int | None = None) -> OrderDirectory:
        """``order`` is total.  The files lie in ``root``, by default a folder beside the checkpoints."""
        spark = df.sparkSession
        root = root or f"{ensure_checkpoint_dir(spark).rstrip('/')}/order-{uuid.uuid4().hex}"
        placed = df.repartitionByRange(ranges or task_count(df), *order).withColumn(RANGE, F.spark_partition_id())
        placed.sortWithinPartitions(RANGE, *order).write.partitionBy(RANGE).parquet(root)
        rows = spark.read.parquet(root)
        # One row for each range.
        counts = rows.groupBy(RANGE).agg(F.count(F.lit(1)).alias("n")).orderBy(RANGE).collect()
        starts, before = [], 0
        for r in counts:
            starts.append((r[RANGE], before, r.n))
            before += r.n
        return cls(rows, order, starts)

    def page(self, page: int, per_page: int) -> DataFrame:
        """The rows of one page; beyond the last there are none."""
        first = (page - 1) * per_page
        within = [(k, before) for k, before, n in self.starts if before < first + per_page and before + n > first]
        chosen = self.rows.where(F.col(RANGE).isin([k for k, _ in within])).drop(RANGE)
        skip = first - within[0][1] if within else 0
        return chosen.orderBy(*self.order).offset(skip).limit(per_page)


Order = list[tuple[str, str]]  # (column, one of the orders below), the last column telling all rows apart
ORDERS = {
    "asc": F.asc, "desc": F.desc, "asc_nulls_first": F.asc_nulls_first, "asc_nulls_last": F.asc_nulls_last,
    "desc_nulls_first": F.desc_nulls_first, "desc_nulls_last": F.desc_nulls_last,
}


def sorted_by(order: Order) -> list[Column]:
    return [ORDERS[way](column) for column, way in order]


def page_of(df: DataFrame, order: Order, page: int, per_page: int, shallow: int = SHALLOW_ROWS) -> DataFrame:
    """One page of ``df``; a deep one orders the sort columns alone and fetches its rows after."""
    by = sorted_by(order)
    if page * per_page <= shallow:
        return df.orderBy(*by).offset((page - 1) * per_page).limit(per_page)
    key = order[-1][0]
    wanted = OrderDirectory.build(df.select(*dict.fromkeys(c for c, _ in order)), by).page(page, per_page).select(F.col(key).alias("_key"))
    return df.join(F.broadcast(wanted), df[key].eqNullSafe(F.col("_key"))).drop("_key").orderBy(*by)  # per_page keys
