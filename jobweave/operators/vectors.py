"""Nearest neighbours by cosine: exactly, block by block, or among the buckets of random hyperplanes.

Blocks of queries meet blocks of vectors in tasks; no vector passes the driver, and both tables are
read once however many blocks they make.  Each cell returns the best k of its own vectors for
each of its queries; only those meet in a shuffle.  Nothing is left out by a bound, so near
copies and ties cannot be lost.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobweave.operators.blocks import best_columns, cogroup_cells, grid_of, meet_blocks
from jobweave.operators.search import top_k_per_query
from jobweave.operators.skew import task_count
from jobweave.session import cut_lineage

DIGITS = 10
BLOCK_NUMBERS = 1 << 21  # components in a block
SIMILARITIES = 1 << 20  # computed at once


def split_by_length(vectors: DataFrame, dims: int, column: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """(usable, rejected): vectors of the index's length, and the others."""
    fits = F.coalesce(F.size(column) == dims, F.lit(False))
    return vectors.where(fits), vectors.where(~fits)


@dataclass(frozen=True)
class VectorIndex:
    """The stored vectors of one length; ``rejected`` are the others, with all their columns."""

    vectors: DataFrame
    key: str
    column: str
    dims: int
    rejected: DataFrame

    def split_queries(self, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(queries that can be asked, queries whose vector is missing or of another length)."""
        return split_by_length(queries, self.dims)


def build_vector_index(vectors: DataFrame, *, key: str = "job_id", column: str = "embedding", dims: int | None = None) -> VectorIndex:
    """Vectors of length ``dims``, by default the most frequent length."""
    if dims is None:
        sizes = vectors.where(F.size(column) > 0).groupBy(F.size(column).alias("n")).count()
        top = sizes.orderBy(F.desc("count"), "n").first()
        dims = top.n if top else 0
    usable, rejected = split_by_length(vectors, dims, column)
    return VectorIndex(usable.select(key, column), key, column, dims, rejected)


def _units(lists: pa.ChunkedArray | pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows, and a mask of the rows that have a direction."""
    flat = pc.cast(pc.list_flatten(lists), pa.float64())
    matrix = np.array(flat.to_numpy(zero_copy_only=False) if isinstance(flat, pa.Array) else flat.to_numpy()).reshape(len(lists), dims)
    norms = np.linalg.norm(matrix, axis=1)
    has = (norms > 0) & np.isfinite(norms)
    return matrix[has] / norms[has][:, None], has


def _nearest(asked: pa.Table, stored: pa.Table, dims: int, top_k: int) -> pa.Table:
    """(query_id, job_id, score): for each query of a cell the best of the cell's vectors, ties to the smaller id."""
    stored = stored.sort_by("job_id")
    queries, with_direction = _units(asked["embedding"], dims)
    units, used = _units(stored["embedding"], dims)
    query_ids, job_ids = asked["query_id"].filter(pa.array(with_direction)), stored["job_id"].filter(pa.array(used))
    rows, columns, scores = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
    step = max(1, SIMILARITIES // max(len(units), 1))
    for at in range(0, len(queries), step) if len(units) else ():
        # Rounded before they are ranked, so that the order of summing decides no rank.
        sims = np.round(queries[at:at + step] @ units.T, DIGITS)
        r, c = best_columns(sims, top_k)
        rows.append(r + at)
        columns.append(c)
        scores.append(sims[r, c])
    r, c = np.concatenate(rows), np.concatenate(columns)
    return pa.table({"query_id": query_ids.take(pa.array(r)), "job_id": job_ids.take(pa.array(c)), "score": np.concatenate(scores)})


def _schema(asked: DataFrame, index: VectorIndex) -> T.StructType:
    return T.StructType([
        T.StructField("query_id", asked.schema["query_id"].dataType),
        T.StructField("job_id", index.vectors.schema[index.key].dataType), T.StructField("score", T.DoubleType())])


def _stored(index: VectorIndex) -> DataFrame:
    return index.vectors.select(F.col(index.key).alias("job_id"), F.col(index.column).alias("embedding"))


def _ranked(found: DataFrame, top_k: int) -> DataFrame:
    return top_k_per_query(found, top_k).withColumn("score", F.round((1 + F.col("score")) / 2, DIGITS))


def search_knn(index: VectorIndex, queries: DataFrame, *, top_k: int = 10) -> DataFrame:
    """(query_id, rank, job_id, score) with score = (1 + cosine) / 2, exact.

    ``queries``: query_id, embedding of the index's length; ``VectorIndex.split_queries`` names the others.
    """
    asked, stored = index.split_queries(queries)[0].select("query_id", "embedding"), _stored(index)
    dims = index.dims
    grid = grid_of(asked, stored, max(256, BLOCK_NUMBERS // max(dims, 1)))
    found = meet_blocks(
        asked, stored, (F.xxhash64("query_id", "embedding"), F.xxhash64("job_id", "embedding")), grid,
        lambda a, b: _nearest(a, b, dims, top_k), _schema(asked, index))
    return _ranked(found, top_k)


# --- hyperplanes -----------------------------------------------------------------------------

@dataclass(frozen=True)
class Hyperplanes:
    """``tables`` times ``bits`` random hyperplanes: vectors on the same side of all planes of a table share
    its bucket.  A query also looks into the buckets that differ in one plane."""

    tables: int = 40
    bits: int = 8
    seed: int = 7

    def buckets(self, units: np.ndarray) -> np.ndarray:
        """Bucket of each row in each table."""
        planes = np.random.default_rng(self.seed).normal(size=(units.shape[1], self.tables * self.bits))
        sides = (units @ planes > 0).reshape(len(units), self.tables, self.bits)
        return sides @ (1 << np.arange(self.bits))


def _in_buckets(rows: DataFrame, dims: int, planes: Hyperplanes, probes: bool) -> DataFrame:
    """``rows`` once for each table, and with ``probes`` for each neighbouring bucket too; those without a direction go."""
    def run(batches):
        flips = np.concatenate([[0], 1 << np.arange(planes.bits)]) if probes else np.zeros(1, np.int64)
        for batch in batches:
            units, has = _units(batch["embedding"], dims)
            kept = batch.filter(pa.array(has))
            for at in range(0, len(units), 1_000):
                own = planes.buckets(units[at:at + 1_000])
                all_buckets = own[:, :, None] ^ flips
                n, per = len(own), planes.tables * len(flips)
                out = kept.take(pa.array(np.repeat(np.arange(at, at + n), per)))
                table = np.tile(np.repeat(np.arange(planes.tables), len(flips)), n)
                yield pa.RecordBatch.from_arrays(
                    [*out.columns, pa.array(table, pa.int32()), pa.array(all_buckets.reshape(-1), pa.int64())], names=[*out.schema.names, "_table", "_bucket"])

    fields = [*rows.schema.fields, T.StructField("_table", T.IntegerType()), T.StructField("_bucket", T.LongType())]
    return rows.mapInArrow(run, T.StructType(fields))


def search_hyperplanes(index: VectorIndex, queries: DataFrame, *, top_k: int = 10, planes: Hyperplanes = Hyperplanes()) -> DataFrame:
    """As ``search_knn``, among the vectors that share a bucket with the query, by exact scores.

    Every vector is in ``tables`` buckets.  A crowded bucket is split into blocks of bounded size, each of
    which its queries visit.  More tables raise the recall, more bits lower the number of vectors
    looked at; ``recall_against`` measures what a setting gives.
    """
    asked, dims = index.split_queries(queries)[0].select("query_id", "embedding"), index.dims
    stored = _in_buckets(_stored(index), dims, planes, probes=False)
    # One row for each bucket: tables x 2^bits at most, whatever the number of vectors.
    block = max(256, BLOCK_NUMBERS // max(dims, 1))
    sizes = cut_lineage(stored.groupBy("_table", "_bucket").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_blocks")))
    sizes = F.broadcast(sizes)
    stored = stored.join(sizes, ["_table", "_bucket"]).withColumn("_block", F.pmod(F.xxhash64("job_id"), F.col("_blocks")).cast("int")).drop("_blocks")
    visits = _in_buckets(asked, dims, planes, probes=True).join(sizes, ["_table", "_bucket"])
    visits = visits.withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).drop("_blocks")
    found = cogroup_cells(
        visits, stored, ["_table", "_bucket", "_block"], 4 * task_count(stored),
        lambda a, b: _nearest(a, b, dims, top_k), _schema(asked, index))
    return _ranked(found.distinct(), top_k)


def recall_against(exact: DataFrame, found: DataFrame) -> DataFrame:
    """(queries, wanted, found, recall): the share of the exact hits that were found."""
    both = exact.select("query_id", "job_id").join(found.select("query_id", "job_id", F.lit(1).alias("_hit")), ["query_id", "job_id"], "left")
    return both.agg(
        F.count_distinct("query_id").alias("queries"), F.count(F.lit(1)).alias("wanted"), F.count("_hit").alias("found"),
        (F.count("_hit") / F.count(F.lit(1))).alias("recall"))
