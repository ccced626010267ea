"""The operators over their whole tables, with the columns that their contracts name."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobweave.llm import bpe, exact_dedup, hard_negatives, language_id, mixing, near_dedup, preference, quality, sentence_pieces, spelling, sql, token_files, toxicity, url_filter
from jobweave.llm.shared import table, work_path

WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
END_ID = 2
CATEGORIES = ("poor", "toxic")
QUALITY_COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_words_left", "base_failed", "kept"]
URL_RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"),
]


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("poor"), "toxic")
    scored = toxicity.score_chain(docs, toxicity.train_chain(docs, labels, CATEGORIES))
    return scored.withColumnRenamed("flagged", "toxic")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.col("sha256").alias("text_sha256"))


def encoding_digests(encoded: DataFrame, *beside: str) -> DataFrame:
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), *beside)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding_digests(bpe.encode_decode(table(spark, sf_dir, "documents"), WORD_TOKENIZER))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_groups(table(spark, sf_dir, "documents"), forest=near_dedup.Forest(words=2))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs.where(~language_id.held_out(F.col("doc_id"))))
    found = language_id.predict(docs, model)
    return found.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op6_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference.format_preferences(*preference.reply_pairs(table(spark, sf_dir, "conversations")))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = work_path(spark, "tokens")
    token_files.write_tokens(table(spark, sf_dir, "documents"), out, WORD_TOKENIZER, END_ID)
    return token_files.read_checked(token_files.read_tokens(spark, out))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = [F.struct(*[F.lit(v).alias(c) for v, c in zip(rule, ("host", "path", "action"))]) for rule in URL_RULES]
    rules = spark.range(1).select(F.inline(F.array(*each)))
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).select(*QUALITY_COLUMNS)


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    counts = spelling.word_counts(docs, drop_one_in=97)
    return spelling.forms(counts).select("word", "form", "root", "n", "n_near", "form_n")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", moved), F.col("id") % 50 == 0, "vec_id", "embedding", "label")


def op13_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding_digests(sentence_pieces.encode_decode(table(spark, sf_dir, "documents"), PIECE_MODEL))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_toxicity, op2_exact_dedup, op3_bpe, op4_near_dedup, op5_language_id, op6_preference, op7_token_files, op8_mixing,
        op9_url_filter, op10_quality, op11_spelling, op12_hard_negatives, op13_sentence_pieces,
    )
}

SQL: dict[str, str] = {
    "op2_exact_dedup": sql.OP2, "op6_preference": sql.OP6, "op8_mixing": sql.OP8, "op9_url_filter": sql.OP9, "op10_quality": sql.OP10,
    "op11_spelling": sql.OP11, "op12_hard_negatives": sql.OP12,
}
