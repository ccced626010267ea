"""Turning texts into vectors with a user function, each distinct input once."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobweave.functions.text import content_key, embed_profile, embedding_input, posting_text
from jobweave.operators.skew import attach_by_key


def hashing_embedder(dims: int) -> Callable[[pd.Series], list[np.ndarray | None]]:
    """Signed feature hashing of the words: deterministic, no model needed."""

    def embed(texts: pd.Series) -> list[np.ndarray | None]:
        out: list[np.ndarray | None] = []
        for text in texts:
            vector = np.zeros(dims)
            for word in (text or "").lower().split():
                h = zlib.crc32(word.encode())
                vector[(h >> 1) % dims] += 1.0 if h & 1 else -1.0
            out.append(vector if vector.any() else None)
        return out

    return embed


def embed_texts(
    texts: DataFrame, *, dims: int, embed_fn: Callable[[pd.Series], list] | None = None, key: str = "job_id",
    text: str = "text", source: str = "ollama", model: str = "", profile: str = "", usage: str = "document",
) -> DataFrame:
    """(key, content_key, embedding, ok).  ``ok`` is false for a blank text or a vector of
    another length; rows stay keyed, so a failure never shifts its neighbours."""
    embed_fn = embed_fn or hashing_embedder(dims)
    chosen = embed_profile(F.lit(source), F.lit(model), F.lit(profile))
    prepared = texts.select(key, embedding_input(F.col(text), chosen, F.lit(usage)).alias("_input")).withColumn(
        "content_key", content_key(F.col("_input"), F.lit(model), F.lit(source), chosen, F.lit(usage))
    )
    # One row per distinct input; min() keeps the aggregation combinable map-side.
    inputs = prepared.where("_input <> ''").groupBy("content_key").agg(
        F.min("_input").alias("_input"), F.count(F.lit(1)).alias("uses")
    )
    schema = T.StructType([
        T.StructField("content_key", T.StringType()), T.StructField("uses", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("ok", T.BooleanType()),
    ])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            vectors = list(embed_fn(batch["_input"]))
            vectors += [None] * (len(batch) - len(vectors))
            good = [v is not None and len(v) == dims for v in vectors]
            yield pd.DataFrame({
                "content_key": batch["content_key"], "uses": batch["uses"],
                "embedding": [np.asarray(v, dtype="float32") if g else None for v, g in zip(vectors, good)], "ok": good,
            })

    embedded = inputs.mapInPandas(run, schema)
    out = attach_by_key(prepared.select(key, "content_key"), embedded, ["content_key"], "uses", key)
    return out.select(key, "content_key", "embedding", F.coalesce("ok", F.lit(False)).alias("ok"))


def embed_postings(postings: DataFrame, **options) -> DataFrame:
    return embed_texts(postings.select(F.col("id").alias("job_id"), posting_text().alias("text")), **options)
