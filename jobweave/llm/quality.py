"""Quality rules: line frequency across documents, on top of rules on the number of words and repetition.

Everything here is DataFrame expressions; no text leaves the JVM and no text is shuffled
unless the table of documents with frequent lines is too large for a broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobweave.llm.shared import WORD, fingerprint, numbered, small_side, stash

SPACE_RUN = "[\\x20\\x09\\x0B-\\x0D]+"
SYMBOL = "[#*$%&|<>]"


@dataclass(frozen=True)
class LineRules:
    """A line is frequent on a host when at least ``min_docs`` different texts of that host hold it,
    however many texts the host has.  A document is depleted when less than
    ``min_left`` of its words, or fewer than ``min_words`` words, stay without such lines."""

    min_docs: int = 20
    min_left: float = 0.3
    min_words: int = 10
    max_repeat_percent: int = 20


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def _windows(words: Column) -> Column:
    """One 64-bit hash for each window of five words."""
    last = F.size(words) - 5
    starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(5)]))


def _side_by_side(windows: Column) -> Column:
    """(hash, position) of all windows, equal windows side by side."""
    return F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("hash"), i.alias("at"))))


def _covered(positions: Column) -> Column:
    """Words covered by five-word windows at these ascending positions."""
    return F.aggregate(
        positions, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-5).cast("int").alias("last")),
        lambda acc, p: F.struct((acc["n"] + F.least(F.lit(5), p - acc["last"])).alias("n"), p.alias("last")),
        lambda acc: acc["n"],
    )


def once(**columns: Column) -> Column:
    """Columns that are computed where they stand.  A filter on one of them would else be moved
    down with a copy of what it is made from, also into the functions over array elements,
    where an array would be made anew for each element."""
    return F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()])))


def base_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words."""
    c = F.coalesce(F.col(text), F.lit(""))
    df = docs.withColumn("_words", words_of(c))
    df = df.withColumn("_win", _windows(F.col("_words")))
    df = df.withColumn("_lines", F.filter(F.split(c, "\n"), lambda x: x.rlike(WORD)))
    # Only texts that repeat a window at all pay for the sort.
    df = df.withColumn("_repeats", F.size("_win") > F.size(F.array_distinct("_win")))
    df = df.withColumn("_at", F.when(F.col("_repeats"), _side_by_side(F.col("_win"))))
    at = F.col("_at")
    same = lambda x, i: F.coalesce(x["hash"] == F.get(at, i)["hash"], F.lit(False))
    again = F.filter(at, lambda x, i: ((i > 0) & same(x, i - 1)) | same(x, i + 1))
    df = df.withColumn("_starts", F.when(F.col("_repeats"), F.sort_array(F.transform(again, lambda x: x["at"]))))
    return df.select(*docs.columns, once(
        n_words=F.size("_words").cast("long"),
        word_chars=F.length(F.concat_ws("", "_words")).cast("long"),
        n_symbols=F.regexp_count(c, F.lit(SYMBOL)).cast("long"),
        n_dup_lines=(F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        n_repeat_words=F.coalesce(F.when(F.col("_repeats"), _covered(F.col("_starts"))), F.lit(0)).cast("long"),
    ))


def normal_lines(text: Column) -> Column:
    """Lines in lower case with single spaces and none at the ends, in their order."""
    flat = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), SPACE_RUN, " ")
    return F.transform(F.split(flat, "\n"), lambda x: F.btrim(x))


def _line_rows(docs: DataFrame, text: str, host: str) -> DataFrame:
    """(host key, document key, line hash) of each line that has a word."""
    host_key = F.xxhash64(F.col(host).isNull(), F.col(host)).alias("_host")
    rows = docs.select(host_key, *fingerprint(host, text), F.explode(normal_lines(F.col(text))).alias("_line"))
    return rows.where("_line <> ''").select("_host", "_h1", "_h2", F.xxhash64("_line").alias("_lh"))


def frequent_lines(docs: DataFrame, text: str, host: str, rules: LineRules) -> DataFrame:
    """(host key, line hash) of the lines above the limit.

    Documents are told apart by text, so copies of one document count once.  Distinct
    (host, line, document) rows are spread by all three before they are counted, so a line that
    a third of all documents hold is counted in many tasks.
    """
    lines = _line_rows(docs, text, host).select("_host", "_lh", "_h1").distinct()
    counts = lines.groupBy("_host", "_lh").agg(F.count(F.lit(1)).alias("_docs")).where(F.col("_docs") >= rules.min_docs)
    return stash(counts.select("_host", "_lh"), "frequent_lines")


def line_hits(docs: DataFrame, text: str, host: str, rules: LineRules) -> DataFrame:
    """Per (host, text) that holds frequent lines: the hashes of those lines.

    The list is no longer than the text has lines.
    """
    rows = _line_rows(docs, text, host)
    hit = rows.join(small_side(frequent_lines(docs, text, host, rules)), ["_host", "_lh"])
    return hit.select("_h1", "_h2", "_lh").distinct().groupBy("_h1", "_h2").agg(F.collect_list("_lh").alias("_hashes"))


def judge(
    docs: DataFrame, text: str = "text", host: str = "source", rules: LineRules | None = None,
) -> DataFrame:
    """All columns of ``docs`` with measures, ``cleaned_text``, ``base_failed`` and ``kept``.

    A null text has no words and fails; a null host is a host of its own.  Repeated rows all
    get the same verdict.  Columns of ``docs`` that bear the name of a measure are replaced; the
    others stay as they are.  An empty table gives an empty result.
    """
    rules = rules or LineRules()
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "cleaned_text", "n_words_left", "base_failed", "kept"]
    inner, name = numbered(docs)
    body, place = name[text], name[host]
    hits = stash(line_hits(inner.select(body, place), body, place, rules), "line_hits")
    df = base_measures(inner, body).withColumns(dict(zip(("_h1", "_h2"), fingerprint(place, body))))
    df = df.join(small_side(hits), ["_h1", "_h2"], "left")
    # Lines go out of the original text by position, so the rest keeps its form.
    lines = F.zip_with(F.split(F.col(body), "\n"), normal_lines(F.col(body)), lambda r, x: F.when(~F.array_contains("_hashes", F.xxhash64(x)), r))
    left = F.array_join(F.filter(lines, lambda x: x.isNotNull()), "\n")
    df = df.select("*", once(cleaned_text=F.when(F.col("_hashes").isNull(), F.col(body)).otherwise(left)))
    df = df.withColumn("n_words_left", F.when(F.col("_hashes").isNull(), F.col("n_words")).otherwise(
        F.regexp_count(F.col("cleaned_text"), F.lit(WORD)).cast("long")))
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    depleted = F.col("_hashes").isNotNull() & (
        (F.col("n_words_left") < rules.min_words) | (F.col("n_words_left") < rules.min_left * F.col("n_words")))
    df = df.withColumn("base_failed", failed).withColumn("kept", ~failed & ~depleted)
    return df.select(*[F.col(name[c]).alias(c) for c in docs.columns if c not in made], *made)
