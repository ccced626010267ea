"""The corpus pipeline: quality rules, exact and near duplicates, mixing, encoding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobweave.llm import bpe, exact_dedup, mixing, near_dedup, quality
from jobweave.llm.queries import WORD_TOKENIZER, encoding_digests
from jobweave.llm.shared import apply_times, numbered, table, work_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; frequent lines go from the texts of the others, whose n_chars, if there is one, follows.

    A null or empty text has no words and is rejected; a null source is a host of its own.  Texts of any
    length are judged whole, repeated rows alike.  All columns come out as they are, whatever their names;
    an empty table stays one.
    """
    inner, name = numbered(docs)
    judged = quality.judge(inner, name["text"], name["source"]).where("kept")
    changed = ~F.col("cleaned_text").eqNullSafe(F.col(name["text"]))
    columns = {"text": F.col("cleaned_text")}
    if "n_chars" in name:
        columns["n_chars"] = F.when(changed, F.char_length("cleaned_text").cast("long")).otherwise(F.col(name["n_chars"]))
    return judged.select(*[columns.get(c, F.col(name[c])).alias(c) for c in docs.columns])


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal but for A-Z stays: the one with the largest doc_id.

    A null text counts as empty, a null doc_id as smaller than any other; of repeated rows one stays.
    Whole texts of any length are compared.  Columns and empty tables stay as they are.
    """
    return apply_times(docs, exact_dedup.exact_decisions(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates stays: the one with the smallest doc_id.

    A text without words, or a null one, is linked with nothing and stays; a null doc_id comes after all
    others; of repeated rows one stays.  Whole texts are compared.  Columns and empty tables stay as they are.
    """
    found = near_dedup.near_groups(docs)
    return apply_times(docs, found.select(
        F.col("doc_id").alias("_key"), "_h1", "_h2", F.col("chosen").cast("int").alias("times")), once=True)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, which is 0 to 3 times.

    A null text has size 0; a null source is a source, the last in order.  The random number of a document
    depends on doc_id and text, so reruns agree and repeated rows share it.  Long texts count with all their
    words.  Columns and empty tables stay as they are.
    """
    return apply_times(docs, mixing.mix(docs).select(F.col("doc_id").alias("_key"), "_h1", "_h2", "times"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids, source and language of every document, with the number and digest of the ids and the digest of the text decoded from them.

    A null text is empty and has no ids; a text of any length is encoded whole, repeated rows each time.
    Other columns are left behind, whatever their names; an empty table gives no rows.
    """
    return encoding_digests(bpe.encode_decode(docs, WORD_TOKENIZER, beside=["source", "lang"]), "ids", "source", "lang")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("exact_duplicates", exact_duplicates),
    ("near_duplicates", near_duplicates),
    ("mix_sources", mix_sources),
    ("encode", encode),
]

# The near-duplicate and encoding stages have no form in SQL; the tests hold run() against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = work_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
