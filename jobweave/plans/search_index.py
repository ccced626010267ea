"""Life of the search index: full and incremental builds, activation, the query gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobweave import schema
from jobweave.operators.dedup import newest_per_key
from jobweave.operators.embed import embed_postings
from jobweave.operators.search import search_documents


def select_for_index(postings: DataFrame, unique_only: bool) -> DataFrame:
    return newest_per_key(postings) if unique_only else postings


def missing_from_index(selected: DataFrame, indexed: DataFrame) -> DataFrame:
    """Selected postings that are not in the index."""
    return selected.join(indexed.select(F.col("job_id").alias("id")), "id", "left_anti")


def active_run(runs: DataFrame) -> DataFrame:
    """The completed run that was activated last."""
    chosen = runs.where("status = 'completed' AND activated_at IS NOT NULL")
    newest = chosen.agg(F.max_by(F.struct(*[F.col(c) for c in runs.columns]), F.struct("activated_at", "run_id")).alias("r"))
    return newest.where("r IS NOT NULL").select("r.*")


def is_queryable(indexed_documents: Column) -> Column:
    """A run may serve queries: completed, active, nothing failed, and a full build is whole."""
    whole = (F.col("mode") != "full") | (
        (F.coalesce("target_total", F.lit(0)) > 0) & (F.coalesce("indexed", F.lit(0)) == F.col("target_total"))
    )
    return (
        (F.col("status") == "completed") & F.col("activated_at").isNotNull() & (F.coalesce("failed", F.lit(0)) == 0)
        & (F.trim(F.coalesce("index_path", F.lit(""))) != "") & whole & (F.coalesce(indexed_documents, F.lit(0)) > 0)
    )


def settings_match(unique_only: bool, source: str, model: str, dims: int, profile: str) -> Column:
    return (
        (F.col("unique_only") == unique_only) & (F.col("embed_source") == source) & (F.col("embed_model") == model)
        & (F.col("embed_dims") == dims) & (F.col("embed_profile") == profile)
    )


class IndexNotUsable(RuntimeError):
    """An incremental build needs an active index with the same settings."""


class IndexStore:
    """Index data under ``root/index`` and run rows, appended, under ``root/runs``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def runs(self) -> DataFrame:
        from pyspark.errors import AnalysisException

        try:
            return self.spark.read.schema(schema.INDEX_RUN).parquet(f"{self.root}/runs")
        except AnalysisException:
            return self.spark.createDataFrame([], schema.INDEX_RUN)

    def _record(self, **row) -> None:
        values = [tuple(row.get(f.name) for f in schema.INDEX_RUN.fields)]
        self.spark.createDataFrame(values, schema.INDEX_RUN).coalesce(1).write.mode("append").parquet(f"{self.root}/runs")

    def read_active(self) -> DataFrame | None:
        run = active_run(self.runs()).first()
        return None if run is None else self._read(run.index_path)

    def _read(self, path: str) -> DataFrame:
        # Incremental builds add folders below the same path.
        return self.spark.read.option("recursiveFileLookup", "true").parquet(path)

    def build(
        self, postings: DataFrame, *, run_id: str, now, mode: str = "full", unique_only: bool = True, dims: int,
        source: str = "ollama", model: str = "", profile: str = "raw-v1", embed_fn=None,
    ) -> bool:
        """Embed and write the selected postings, and activate the run only if it is whole.

        A failed run is recorded and its data is never pointed to; the run that was active
        stays so.
        """
        settings = dict(unique_only=unique_only, embed_source=source, embed_model=model, embed_dims=dims, embed_profile=profile)
        selected = select_for_index(postings, unique_only)
        if mode == "full":
            path, todo = f"{self.root}/index/{run_id}", selected
        else:
            active = active_run(self.runs())
            run = active.where(settings_match(unique_only, source, model, dims, profile)).first()
            if run is None or active.where(is_queryable(F.lit(self._read(run.index_path).count()))).first() is None:
                raise IndexNotUsable("run a full build with these settings first")
            path, todo = run.index_path, missing_from_index(selected, self._read(run.index_path))
        part = f"{path}/part={run_id}"
        # A posting that failed is counted, not indexed.  The attempt is written once, so
        # the count and the index come from the same vectors.
        vectors = embed_postings(todo, dims=dims, embed_fn=embed_fn, source=source, model=model, profile=profile)
        attempt = f"{self.root}/attempts/{run_id}"
        vectors.write.parquet(attempt)
        stored = self.spark.read.schema(vectors.schema).parquet(attempt)
        totals = stored.agg(F.count(F.lit(1)).alias("total"), F.count_if(~F.col("ok")).alias("failed")).first()
        base = dict(run_id=run_id, mode=mode, target_total=totals.total, failed=totals.failed, index_path=path, **settings)
        complete = totals.failed == 0 and (mode != "full" or totals.total > 0)
        if not complete:
            self._record(
                status="failed", indexed=0, activated_at=None,
                error_message=f"incomplete: failed={totals.failed} target_total={totals.total}", **base,
            )
            return False
        search_documents(todo, stored.where("ok")).write.parquet(part)
        indexed = self.spark.read.parquet(part).count() if totals.total else 0
        done = indexed == totals.total
        self._record(
            status="completed" if done else "failed", indexed=indexed, activated_at=now if done else None,
            error_message=None if done else f"incomplete: indexed={indexed} target_total={totals.total}", **base,
        )
        return done
