"""Declared schemas.  Nothing in the library infers a schema from data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_STRINGS = T.ArrayType(T.StringType())

POSTING = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("url", T.StringType(), False),
    T.StructField("source", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("company", T.StringType()),
    T.StructField("location", _STRINGS),
    T.StructField("salary_min", T.DoubleType()),
    T.StructField("salary_max", T.DoubleType()),
    T.StructField("salary_currency", T.StringType()),
    T.StructField("salary_type", T.StringType()),
    T.StructField("salary_period", T.StringType()),
    T.StructField("salary_min_pln", T.DoubleType()),
    T.StructField("salary_max_pln", T.DoubleType()),
    T.StructField("skills_required", _STRINGS),
    T.StructField("skills_nice_to_have", _STRINGS),
    T.StructField("seniority", T.StringType()),
    T.StructField("work_type", T.StringType()),
    T.StructField("employment_types", _STRINGS),
    T.StructField("description", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("is_reposted", T.BooleanType()),
    T.StructField("original_job_id", T.StringType()),
    T.StructField("date_published", T.StringType()),
    T.StructField("date_expires", T.StringType()),
    T.StructField("date_added", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("applied_date", T.StringType()),
    T.StructField("notes", T.StringType()),
    T.StructField("saved", T.BooleanType()),
    T.StructField("created_at", T.TimestampType()),
])

# What an extractor yields before ingest assigns id, status and stamps.
PARSED = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("company", T.StringType()),
    T.StructField("location", _STRINGS),
    T.StructField("salary_min", T.DoubleType()),
    T.StructField("salary_max", T.DoubleType()),
    T.StructField("salary_currency", T.StringType()),
    T.StructField("salary_type", T.StringType()),
    T.StructField("explicit_period", T.StringType()),
    T.StructField("skills_required", _STRINGS),
    T.StructField("skills_nice_to_have", _STRINGS),
    T.StructField("seniority", T.StringType()),
    T.StructField("work_type", T.StringType()),
    T.StructField("employment_types", _STRINGS),
    T.StructField("description", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("date_published", T.StringType()),
    T.StructField("date_expires", T.StringType()),
    T.StructField("dropped_skills", _STRINGS),
])

# One posting of the JSON board.  ``category`` is a string or an object, so it is read raw.
FEED = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("location", T.StructType([
        T.StructField("places", T.ArrayType(T.StructType([T.StructField("city", T.StringType())]))),
        T.StructField("fullyRemote", T.BooleanType()),
        T.StructField("hybridDesc", T.StringType()),
    ])),
    T.StructField("fullyRemote", T.BooleanType()),
    T.StructField("salary", T.StructType([
        T.StructField("from", T.DoubleType()),
        T.StructField("to", T.DoubleType()),
        T.StructField("currency", T.StringType()),
        T.StructField("type", T.StringType()),
    ])),
    T.StructField("tiles", T.StructType([
        T.StructField("values", T.ArrayType(T.StructType([
            T.StructField("type", T.StringType()),
            T.StructField("value", T.StringType()),
        ]))),
    ])),
    T.StructField("seniority", _STRINGS),
    T.StructField("posted", T.LongType()),
    T.StructField("description", T.StringType()),
    T.StructField("offerDescription", T.StringType()),
    T.StructField("body", T.StringType()),
    T.StructField("content", T.StringType()),
])

DETECTED = T.StructType([
    T.StructField("job_id", T.StringType(), False),
    T.StructField("skill_name", T.StringType(), False),
    T.StructField("source_field", T.StringType()),
])

INDEX_RUN = T.StructType([
    T.StructField("run_id", T.StringType(), False),
    T.StructField("status", T.StringType()),
    T.StructField("mode", T.StringType()),
    T.StructField("unique_only", T.BooleanType()),
    T.StructField("embed_source", T.StringType()),
    T.StructField("embed_model", T.StringType()),
    T.StructField("embed_dims", T.IntegerType()),
    T.StructField("embed_profile", T.StringType()),
    T.StructField("target_total", T.LongType()),
    T.StructField("indexed", T.LongType()),
    T.StructField("failed", T.LongType()),
    T.StructField("index_path", T.StringType()),
    T.StructField("activated_at", T.TimestampType()),
    T.StructField("error_message", T.StringType()),
])

INFERENCE_LOG = T.StructType([
    T.StructField("created_at", T.TimestampType()),
    T.StructField("model", T.StringType()),
    T.StructField("operation", T.StringType()),
    T.StructField("latency_ms", T.LongType()),
    T.StructField("input_tokens", T.LongType()),
    T.StructField("output_tokens", T.LongType()),
    T.StructField("user_id", T.LongType()),
])

IMPORT_STATUS = T.StructType([
    T.StructField("source", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("total", T.LongType()),
    T.StructField("processed", T.LongType()),
    T.StructField("imported", T.LongType()),
    T.StructField("skipped", T.LongType()),
    T.StructField("errors", T.LongType()),
    T.StructField("error_log", _STRINGS),
    T.StructField("pending_urls", _STRINGS),
])


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project ``df`` onto ``schema``; absent columns become typed NULLs."""
    have = set(df.columns)
    return df.select(*[
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema.fields
    ])
