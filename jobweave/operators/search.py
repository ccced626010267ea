"""Keyword search over a term table: BM25 per field, best field wins, top-k per query.

Texts are cut into tokens once, as they are read, and meet the asked terms there; only counts of asked
terms are shuffled, by document, so a frequent term never gathers its postings in one task.  A
bound on each query's last place, and the most that any document can owe to a term, tell which
terms can bring a document into the list at all; documents that hold only others are not scored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobweave import fixed_values as fv
from jobweave.functions.text import no_strings, skills_combined, strip
from jobweave.operators.blocks import best_columns
from jobweave.operators.skew import broadcast_if_small, spread_if_few, task_count
from jobweave.session import cut_lineage, keep

K1 = 1.2
B = 0.75
WHOLE_VALUE_FIELDS = {"company"}


def search_documents(postings: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """Posting (and vector) as a search document."""
    docs = postings.select(
        F.col("id").alias("job_id"),
        *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("title", "company", "category", "url")],
        skills_combined().alias("skills_combined"),
        F.coalesce("description", F.lit("")).alias("description"),
    )
    return docs if vectors is None else docs.join(vectors.select("job_id", "embedding"), "job_id")


def analyze(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), 1)


WHOLE = ""  # stands for a document's field itself among its terms; no token is empty


@dataclass(frozen=True)
class TermIndex:
    """``tokens`` (job_id, field, tokens, dl) of texts cut up as they are read, the same by document as ``texts`` (job_id,
    a list of tokens for each field) with the ``ids`` alone, or, for a stored index,
    ``stored``: (job_id, field, term, tf, dl) bucketed or at least clustered by term, and ``stored_fields``."""

    boosts: dict[str, float]
    tokens: DataFrame | None = None
    stored: DataFrame | None = None
    stored_fields: DataFrame | None = None
    texts: DataFrame | None = None
    ids: DataFrame | None = None

    @property
    def fields(self) -> DataFrame:
        """field, docs, avg_dl."""
        return self.stored_fields if self.tokens is None else _field_statistics(self.tokens)

    @property
    def terms(self) -> DataFrame:
        """job_id, field, term, tf, dl of every term."""
        return self.stored if self.tokens is None else _counted(self.tokens.select("job_id", "field", "dl", F.explode("tokens").alias("term")))

    @property
    def frequencies(self) -> DataFrame:
        """field, term, df of every term."""
        return _frequencies(self.terms)

    @property
    def vocabulary(self) -> DataFrame:
        """field, term of every term; a task passes each on once, and no document does."""
        rows = self.stored if self.tokens is None else self.tokens.select("field", F.explode("tokens").alias("term"))
        return rows.select("field", "term").distinct()

    def split(self) -> tuple[DataFrame, DataFrame | None]:
        """(documents with an id of their own, as in ``texts``; rows of the terms of the others, or None if there are no others).

        The fields of several documents of one id and length are one field, as in ``terms``.
        """
        times = self.ids.groupBy("job_id").agg(F.count(F.lit(1)).alias("_times"))
        shared = cut_lineage(times.where("_times > 1").select(F.col("job_id").alias("_id")))
        if shared.isEmpty():
            return self.texts, None
        on, marked = F.col("job_id").eqNullSafe(F.col("_id")), broadcast_if_small(shared)
        each = self.tokens.select("job_id", "field", "dl", F.explode(F.array_append("tokens", F.lit(WHOLE))).alias("term"))
        return self.texts.join(marked, on, "left_anti"), _counted(each.join(marked, on, "left_semi"))

    def look_up(self, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(rows of the terms in ``asked`` (field, term); field, docs, avg_dl), from one reading of the texts.

        Tokens meet the asked terms right after they are cut, before anything is shuffled: only
        counts of asked terms, and one row for each field of a document, move.
        """
        wanted = asked.select("field", "term").distinct()
        if self.tokens is None:
            return keep(self.stored.join(broadcast_if_small(wanted), ["field", "term"], "left_semi")), self.stored_fields
        marks = asked.sparkSession.range(1).select(F.explode(F.array(*[F.lit(f) for f in self.boosts])).alias("field"), F.lit(WHOLE).alias("term"))
        each = self.tokens.select("job_id", "field", "dl", F.explode(F.array_append("tokens", F.lit(WHOLE))).alias("term"))
        rows = keep(_counted(each.join(broadcast_if_small(wanted.unionByName(marks)), ["field", "term"], "left_semi")))
        return rows.where(F.col("term") != WHOLE), cut_lineage(_field_statistics(rows.where(F.col("term") == WHOLE)))


def _counted(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("job_id", "field", "dl", "term").agg(F.count(F.lit(1)).alias("tf")).select("job_id", "field", "term", "tf", "dl")


def _field_statistics(per_field: DataFrame) -> DataFrame:
    return per_field.groupBy("field").agg(F.count(F.lit(1)).alias("docs"), F.avg("dl").alias("avg_dl"))


def _frequencies(terms: DataFrame) -> DataFrame:
    return terms.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))


def build_index(docs: DataFrame, boosts: dict[str, float] | None = None, key: str = "job_id") -> TermIndex:
    """Tokens of every field of ``docs``, cut as the texts are read."""
    boosts = boosts or fv.SEARCH_FIELD_BOOSTS
    def tokens(name: str) -> Column:
        if name in WHOLE_VALUE_FIELDS:
            return F.filter(F.array(F.col(name)), lambda v: v.isNotNull() & (v != ""))
        return analyze(F.col(name))
    texts = spread_if_few(docs.select(key, *boosts)).select(F.col(key).alias("job_id"), *[tokens(f).alias(f) for f in boosts])
    return TermIndex(dict(boosts), tokens=_by_field(texts, list(boosts)), texts=texts, ids=docs.select(F.col(key).alias("job_id")))


def _by_field(texts: DataFrame, names: list[str]) -> DataFrame:
    """(job_id, field, tokens, dl) of the fields that have tokens."""
    per_field = F.filter(
        F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("tokens")) for f in names]),
        lambda e: F.size(e["tokens"]) > 0,
    )
    return texts.select("job_id", F.explode(per_field).alias("_f")).select(
        "job_id", "_f.field", "_f.tokens", F.size("_f.tokens").cast("bigint").alias("dl"))


def write_index(index: TermIndex, root: str) -> None:
    """Store the term table, ordered by term so that a search reads few row groups, and its statistics."""
    index.terms.repartitionByRange("term").sortWithinPartitions("term", "field").write.parquet(f"{root}/terms")
    index.fields.write.parquet(f"{root}/fields")


def read_index(spark: SparkSession, root: str, boosts: dict[str, float] | None = None) -> TermIndex:
    return TermIndex(
        dict(boosts or fv.SEARCH_FIELD_BOOSTS), stored=spark.read.parquet(f"{root}/terms"), stored_fields=spark.read.parquet(f"{root}/fields"))


def _query_terms(queries: DataFrame, index: TermIndex, query: str, text: str) -> DataFrame:
    """(query_id, field, term, n): analyzed terms, and the whole text for whole-value fields."""
    clean = queries.select(F.col(query).alias("query_id"), strip(F.coalesce(text, F.lit(""))).alias("_q")).where("_q <> ''")
    words = clean.select("query_id", F.explode(analyze(F.col("_q"))).alias("term"))
    parts = []
    for name in index.boosts:
        source = clean.select("query_id", F.col("_q").alias("term")) if name in WHOLE_VALUE_FIELDS else words
        parts.append(source.withColumn("field", F.lit(name)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("query_id", "field", "term").agg(F.count(F.lit(1)).alias("n"))


def allowed_edits(term: Column) -> Column:
    return F.when(F.length(term) <= 2, 0).when(F.length(term) <= 5, 1).otherwise(2)


def expand_fuzzy(query_terms: DataFrame, index: TermIndex, vocabulary: DataFrame | None = None) -> DataFrame:
    """Replace each query term by the indexed terms within its edit distance.

    Candidates come from an equi join: cut the asked term into d + 1 pieces; a string within
    d edits of it still contains one of them whole, at most d places away, and is at most d letters longer or shorter.
    The edit distance is then checked on the candidates only, once for each two different terms.
    """
    vocabulary = index.vocabulary if vocabulary is None else vocabulary
    words = vocabulary.where(~F.col("field").isin(list(WHOLE_VALUE_FIELDS))).select("term").distinct()

    def cut(term: Column) -> Column:
        """d + 1 pieces of equal length, the last with the rest, each with its place."""
        d = allowed_edits(term)
        step = F.greatest(F.lit(1), F.floor(F.length(term) / (d + 1)).cast("int"))
        length = lambda i: F.when(i == d, F.length(term)).otherwise(step)
        return F.transform(F.sequence(F.lit(0), d), lambda i: F.struct(F.substring(term, i * step + 1, length(i)).alias("piece"), (i * step + 1).alias("at")))

    asked = query_terms.where(~F.col("field").isin(list(WHOLE_VALUE_FIELDS)))
    near = lambda c: F.explode(F.sequence(F.col(c) - F.col("d"), F.col(c) + F.col("d")))
    pieces = asked.select(F.col("term").alias("asked")).distinct().select(
        "asked", allowed_edits(F.col("asked")).alias("d"), F.length("asked").alias("_long"), F.explode(cut(F.col("asked"))).alias("_p"))
    pieces = pieces.select("asked", "d", "_long", "_p.piece", "_p.at").where("piece <> ''").withColumn("at", near("at")).withColumn("_long", near("_long"))
    # Pieces of the same length at every offset of a vocabulary term.
    lengths = [r[0] for r in pieces.select(F.length("piece")).distinct().collect()]
    def grams_of(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length("term") - n + 1, F.lit(1)))
        grams = F.transform(starts, lambda i: F.struct(F.substring(F.col("term"), i, n).alias("piece"), i.alias("at")))
        return F.when(F.length("term") >= n, grams).otherwise(none)

    none = F.array().cast("array<struct<piece:string,at:int>>")
    grams = F.concat(none, *[grams_of(n) for n in sorted(lengths)])
    shards = words.select("term", F.length("term").alias("_long"), F.explode(grams).alias("_g")).select("term", "_long", "_g.piece", "_g.at")
    edits = F.levenshtein("asked", "term", 2)  # -1 beyond
    close = shards.join(broadcast_if_small(pieces), ["piece", "at", "_long"]).select("asked", "term", "d").distinct().where((edits >= 0) & (edits <= F.col("d")))
    weight = F.lit(1.0) - F.levenshtein("term", "asked") / F.least(F.length("term"), F.length("asked"))
    close = cut_lineage(close.select("asked", "term", weight.alias("_w")).where("_w > 0"))
    fuzzy = asked.withColumnRenamed("term", "asked").join(broadcast_if_small(close), "asked").select(
        "query_id", "field", "term", (F.col("n") * F.col("_w")).alias("n"))
    whole = query_terms.where(F.col("field").isin(list(WHOLE_VALUE_FIELDS))).select(
        "query_id", "field", "term", F.col("n").cast("double").alias("n")
    )
    return fuzzy.unionByName(whole).groupBy("query_id", "field", "term").agg(F.sum("n").alias("n"))


FIRST_LOOK = 4  # so many times top_k documents are looked at for each term, to find a bound
FEW = 4  # documents are found first where less than a fourth of the postings does it
MARGIN = 1e-6  # sums of doubles differ by less
SHARED = 64  # a posting that on average counts for more than one in 64 queries is shared by many
WEIGHTS = 1 << 24  # numbers in the matrix of weights that a task holds
PRODUCTS = 1 << 22  # computed at once
CELLS = 1 << 23  # weights, other than 0, that a task holds
TASK_POSTINGS = 1 << 19  # so many postings are scored in one task


def search_keyword(
    index: TermIndex, queries: DataFrame, *, top_k: int = 10, query: str = "query_id", text: str = "query_text",
    fuzzy: bool = False, digits: int = 9,
) -> DataFrame:
    """(query_id, rank, job_id, score) for many queries at once.

    Scores are rounded before ranking so that summation order cannot change a rank; ties
    go to the smaller job id.
    """
    terms = _query_terms(queries, index, query, text)
    if fuzzy and index.texts is not None:
        lone, others = index.split()
        known = keep(_documents_of_terms(_by_field(lone, list(index.boosts)), others))
        terms = cut_lineage(expand_fuzzy(terms, index, known.where(F.col("term") != WHOLE)))
        weighted, lengths = weigh_terms(index, terms, known)
        if weighted.count() <= CELLS:
            best = score_texts(lone, others, weighted, lengths, top_k, digits)
            return cut_lineage(top_k_per_query(best.withColumn("score", F.round("score", digits)), top_k))
    elif fuzzy:
        terms = expand_fuzzy(terms, index)
    terms = cut_lineage(terms)
    rows, weighted = weigh(index, terms)
    size = _size(weighted)
    if size.numbers <= WEIGHTS and size.least > 0 and SHARED * size.pairs >= size.postings * size.queries:
        best = score_together(rows, weighted, size.postings, top_k, digits)
        return cut_lineage(top_k_per_query(best.withColumn("score", F.round("score", digits)), top_k))
    needed = needed_terms(rows, weighted, top_k)
    # Where most postings bring documents in, finding them first saves nothing.
    if FEW * (needed.agg(F.sum("df")).first()[0] or 0) > size.pairs:
        scored = _best_field(rows.join(broadcast_if_small(weighted), ["field", "term"]), digits)
    else:
        scored = score_candidates(rows, weighted, candidates(rows, needed), digits)
    # A list of bounded size, which callers may read more than once.
    return cut_lineage(top_k_per_query(scored, top_k))


def _size(weighted: DataFrame) -> Row:
    """queries, postings, pairs of postings and queries, numbers in the matrix of weights, and the least weight."""
    of_terms = weighted.groupBy("field", "term").agg(
        F.first("df").alias("df"), F.sum("df").alias("pairs"), F.min("w").alias("least")).agg(
        F.count(F.lit(1)).alias("terms"), F.sum("df").alias("postings"), F.sum("pairs").alias("pairs"), F.min("least").alias("least"))
    queries = weighted.select("query_id").distinct().agg(F.count(F.lit(1)).alias("queries"))
    return of_terms.crossJoin(queries).select(
        "queries", (F.col("terms") * F.col("queries")).alias("numbers"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("postings", "pairs", "least")]).first()


def score_together(rows: DataFrame, weighted: DataFrame, postings: int, top_k: int, digits: int = 9) -> DataFrame:
    """(query_id, job_id, score), among them the best ``top_k`` of each query; every posting is scored for every query.

    A document's terms and parts meet in one row, bounded by the asked terms.  A task multiplies the rows of
    its documents by the matrix of weights, which is of bounded size, and passes on the best documents of
    each query; so no pair of document and query is shuffled.
    """
    number = lambda some, names: cut_lineage(some.select(  # noqa: E731  asked queries and terms are few
        *names, (F.row_number().over(Window.orderBy(*names)) - 1).alias("_n")))
    queries = F.broadcast(number(weighted.select("query_id").distinct(), ["query_id"]))
    terms = F.broadcast(number(weighted.select("field", "term").distinct(), ["field", "term"]))
    of_query = weighted.withColumnRenamed("query_id", "_id").join(queries, F.col("_id").eqNullSafe(F.col("query_id")))
    cells = of_query.select("field", "term", "w", F.col("_n").alias("_q")).join(terms, ["field", "term"]).select("field", "_n", "_q", "w").toPandas()
    weights = [(part["_n"].to_numpy(), part["_q"].to_numpy(), part["w"].to_numpy()) for _, part in cells.groupby("field", sort=True)]
    n_queries = int(cells["_q"].max()) + 1 if len(cells) else 0

    tasks = max(task_count(rows), -(-postings // TASK_POSTINGS))
    dealt = rows.join(terms, ["field", "term"]).select("job_id", F.col("_n").alias("_t"), "part").repartition(tasks, "job_id")
    each = dealt.groupBy("job_id", "_t").agg(F.sum("part").alias("part")).groupBy("job_id").agg(F.collect_list(F.struct("_t", "part")).alias("_terms"))
    # In the order of ids, so that of equal scores the first ones stay.
    lists = each.select("job_id", F.transform("_terms", lambda e: e["_t"]).alias("_t"), F.transform("_terms", lambda e: e["part"]).alias("_part"))
    lists = lists.sortWithinPartitions("job_id")
    schema = T.StructType([T.StructField("_q", T.IntegerType()), rows.schema["job_id"], T.StructField("score", T.DoubleType())])
    found = lists.mapInArrow(lambda batches: _best_of_task(batches, weights, n_queries, top_k, digits), schema)
    return found.join(queries, F.col("_q") == F.col("_n")).select("query_id", "job_id", "score")


def _best_of_task(batches: Iterable[pa.RecordBatch], weights: list[tuple], n_queries: int, top_k: int, digits: int) -> Iterator[pa.RecordBatch]:
    """(_q, job_id, score): for each query the best of the task's documents, ties to the first ones.

    ``weights`` has the cells (term, query, weight) of each field; terms are numbered field by field.
    """
    matrix = np.zeros((sum(len(np.unique(t)) for t, _, _ in weights), n_queries))
    for t, q, w in weights:
        matrix[t, q] = w
    ends = [0, *np.cumsum([len(np.unique(t)) for t, _, _ in weights])]
    best, places = np.empty((n_queries, 0)), np.empty((n_queries, 0), np.int64)
    ids, seen = [], 0
    for batch in batches:
        ids.append(batch.column("job_id"))
        lists = batch.column("_t")
        offsets = lists.offsets.to_numpy()
        terms, parts = lists.values.to_numpy(), batch.column("_part").values.to_numpy()
        at = 0
        while at < len(lists):
            # As many documents as the products have room for, one at least.
            room = offsets[at] + PRODUCTS // max(n_queries, 1)
            to = max(at + 1, int(np.searchsorted(offsets, room, side="right")) - 1)
            t, p = terms[offsets[at]:offsets[to]], parts[offsets[at]:offsets[to]]
            doc = np.repeat(np.arange(to - at), np.diff(offsets[at:to + 1]))
            scores = np.full((to - at, n_queries), -np.inf)
            for low, high in zip(ends, ends[1:], strict=False):
                own = (t >= low) & (t < high)
                if own.any():
                    docs, starts = np.unique(doc[own], return_index=True)
                    sums = np.add.reduceat(matrix[t[own]] * p[own][:, None], starts, axis=0)
                    scores[docs] = np.maximum(scores[docs], np.where(sums > 0, sums, -np.inf))
            both = np.concatenate([best, scores.T], axis=1)
            # Ranked as rounded, passed on as they are.
            r, c = best_columns(np.round(both, digits), top_k)
            where = np.concatenate([places, np.broadcast_to(np.arange(seen + at, seen + to), (n_queries, to - at))], axis=1)
            best, places = both[r, c].reshape(n_queries, -1), where[r, c].reshape(n_queries, -1)
            at = to
        seen += len(lists)
    q, c = np.nonzero(best > -np.inf)
    if len(q):
        job_ids = pa.chunked_array(ids).take(pa.array(places[q, c])).combine_chunks()
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), job_ids, pa.array(best[q, c])], names=["_q", "job_id", "score"])


def _documents_of_terms(tokens: DataFrame, others: DataFrame | None) -> DataFrame:
    """(field, term, df, total): in how many documents a term is; for WHOLE those of the field, with the sum of their lengths.

    ``others`` are rows of terms (see ``TermIndex.split``); a task passes each term of the texts on once.
    """
    each = tokens.select("field", F.explode(F.array_append(F.array_distinct("tokens"), F.lit(WHOLE))).alias("term"), "dl")
    if others is not None:
        each = each.unionByName(others.select("field", "term", "dl"))
    return each.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"), F.sum(F.when(F.col("term") == WHOLE, F.col("dl"))).alias("total"))


def weigh_terms(index: TermIndex, terms: DataFrame, known: DataFrame) -> tuple[DataFrame, dict[str, float]]:
    """((query_id, field, term, w) of the asked terms that documents have; average length by field)."""
    fields = {r.field: r for r in known.where(F.col("term") == WHOLE).collect()}  # one row for each searched field
    by_field = lambda values: F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), F.col("field"))
    if not fields:
        return cut_lineage(terms.limit(0).select("query_id", "field", "term", F.col("n").alias("w"))), {}
    docs = by_field({f: r.df for f, r in fields.items()})
    idf = F.log(1 + (docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = known.where(F.col("term") != WHOLE).join(broadcast_if_small(terms), ["field", "term"]).select(
        "query_id", "field", "term", (idf * by_field(index.boosts) * F.col("n")).alias("w"))
    return cut_lineage(weighted), {f: r.total / r.df for f, r in fields.items()}


def score_texts(lone: DataFrame, others: DataFrame | None, weighted: DataFrame, lengths: dict[str, float], top_k: int, digits: int = 9) -> DataFrame:
    """(query_id, job_id, score), among them the best ``top_k`` of each query, from the texts as they are read.

    A task counts the asked terms of its documents, adds up their weights for all queries and passes on the best
    of each query; so neither a text nor a count nor a pair of document and query is shuffled or written.
    """
    number = lambda some, names: cut_lineage(some.select(  # noqa: E731  asked queries and terms are few
        *names, (F.row_number().over(Window.orderBy(*names)) - 1).alias("_n")))
    queries = F.broadcast(number(weighted.select("query_id").distinct(), ["query_id"]))
    terms = number(weighted.select("field", "term").distinct(), ["field", "term"])
    of_query = weighted.withColumnRenamed("query_id", "_id").join(queries, F.col("_id").eqNullSafe(F.col("query_id")))
    cells = of_query.select("field", "term", "w", F.col("_n").alias("_q")).join(broadcast_if_small(terms), ["field", "term"]).select("_n", "_q", "w").toPandas().sort_values("_n")
    asked = terms.orderBy("_n").toPandas()
    counts = np.bincount(cells["_n"], minlength=len(asked))
    weights = _Weights(
        [(f, part["term"].tolist(), int(part["_n"].iloc[0]), lengths[f]) for f, part in asked.groupby("field", sort=False)],
        np.concatenate([[0], np.cumsum(counts)]), cells["_q"].to_numpy(np.int64), cells["w"].to_numpy(float), int(cells["_q"].max()) + 1 if len(cells) else 0)

    def best_of(lists: DataFrame, read: Callable) -> DataFrame:
        kinds = T.StructType([T.StructField("_q", T.IntegerType()), lists.schema["job_id"], T.StructField("score", T.DoubleType())])
        return lists.mapInArrow(lambda batches: _best_of_lists(read(batches, weights), weights, top_k, digits), kinds)

    found = best_of(lone.select("job_id", *[f for f, *_ in weights.fields]), _lists_of_texts)
    if others is not None:
        average = F.element_at(F.create_map(*[F.lit(x) for kv in lengths.items() for x in kv]), F.col("field"))
        rows = others.join(broadcast_if_small(terms), ["field", "term"]).select("job_id", F.col("_n").alias("_t"), _part(average).alias("_part"))
        each = rows.groupBy("job_id", "_t").agg(F.sum("_part").alias("_part")).groupBy("job_id").agg(F.collect_list(F.struct("_t", "_part")).alias("_terms"))
        lists = each.select("job_id", F.transform("_terms", lambda e: e["_t"]).alias("_t"), F.transform("_terms", lambda e: e["_part"]).alias("_part"))
        found = found.unionByName(best_of(lists, _lists_of_counts))
    return found.join(queries, F.col("_q") == F.col("_n")).select("query_id", "job_id", "score")


@dataclass(frozen=True)
class _Weights:
    """Fields with their terms, number of their first term and average length; weights of a term: places ``starts[t]`` to ``starts[t + 1]``."""

    fields: list[tuple[str, list[str], int, float]]
    starts: np.ndarray
    queries: np.ndarray
    values: np.ndarray
    n_queries: int


def _lists_of_texts(batches: Iterable[pa.RecordBatch], weights: _Weights) -> Iterator[tuple]:
    """(ids, documents, terms, parts): ids in their order, postings of the asked terms in the order of documents, which are places of ids."""
    known = [pa.array(terms, pa.string()) for _, terms, _, _ in weights.fields]
    for batch in batches:
        order = pc.sort_indices(batch.column("job_id"), null_placement="at_start")
        ids, order = batch.column("job_id").take(order), order.to_numpy()
        places = np.empty(len(order), np.int64)
        places[order] = np.arange(len(order))
        docs, terms, parts = [], [], []
        for (name, _, first, average), those in zip(weights.fields, known, strict=True):
            lists = batch.column(name)
            offsets = lists.offsets.to_numpy()
            lengths = np.diff(offsets)
            number = pc.fill_null(pc.index_in(lists.values[offsets[0]:offsets[-1]].cast(pa.string()), value_set=those), -1).to_numpy()
            asked = number >= 0
            both, tf = np.unique(np.repeat(places, lengths)[asked] * len(those) + number[asked], return_counts=True)
            doc, term = np.divmod(both, len(those))
            docs.append(doc)
            terms.append(term + first)
            parts.append(tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[order][doc] / average)))
        if docs:
            together = np.argsort(np.concatenate(docs), kind="stable")
            yield (ids, *[np.concatenate(some)[together] for some in (docs, terms, parts)])


def _lists_of_counts(batches: Iterable[pa.RecordBatch], weights: _Weights) -> Iterator[tuple]:
    """As ``_lists_of_texts``, from lists of counted terms."""
    for batch in batches:
        batch = batch.take(pc.sort_indices(batch.column("job_id"), null_placement="at_start"))
        lists = batch.column("_t")
        yield (batch.column("job_id"), np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())),
               lists.flatten().to_numpy().astype(np.int64), batch.column("_part").flatten().to_numpy())


def _best_of_lists(lists: Iterable[tuple], weights: _Weights, top_k: int, digits: int) -> Iterator[pa.RecordBatch]:
    """(_q, job_id, score): for each query the best of the task's documents, ties to the smaller ids."""
    n, ends = weights.n_queries, [*[first for _, _, first, _ in weights.fields], len(weights.starts) - 1]
    best, whose = np.empty((n, 0)), np.empty((n, 0), object)
    kind = None
    for ids, docs, terms, parts in lists:
        kind = ids.type
        names = np.empty(len(ids), object)
        names[:] = ids.to_pylist()
        cells = weights.starts[terms + 1] - weights.starts[terms]
        before = np.concatenate([[0], np.cumsum(np.bincount(docs, cells, minlength=len(ids)))])
        at = 0
        while at < len(ids):
            # As many documents as the products have room for, one at least.
            to = min(int(np.searchsorted(before, before[at] + PRODUCTS, side="right")) - 1, at + PRODUCTS // max(n, 1), len(ids))
            to = max(at + 1, to)
            own = slice(*np.searchsorted(docs, [at, to]))
            scores = np.full((to - at, n), -np.inf)
            for low, high in zip(ends, ends[1:], strict=False):
                field = (terms[own] >= low) & (terms[own] < high)
                if field.any():
                    t, many = terms[own][field], cells[own][field]
                    places = np.repeat(weights.starts[t] - np.cumsum(many) + many, many) + np.arange(many.sum())
                    flat = np.repeat((docs[own][field] - at) * n, many) + weights.queries[places]
                    sums = np.bincount(flat, weights.values[places] * np.repeat(parts[own][field], many), minlength=scores.size).reshape(scores.shape)
                    scores = np.maximum(scores, np.where(sums > 0, sums, -np.inf))
            # Ranked as rounded, passed on as they are; the documents of one stretch come in the order of ids.
            r, c = best_columns(np.round(scores.T, digits), top_k)
            best = np.concatenate([best, scores.T[r, c].reshape(n, -1)], axis=1)
            whose = np.concatenate([whose, names[at:to][c].reshape(n, -1)], axis=1)
            different = {v: i for i, v in enumerate(sorted(set(whose.ravel()), key=lambda v: (v is not None, v)))}
            codes = np.array([different[v] for v in whose.ravel()], np.int64).reshape(whose.shape)
            first = np.lexsort((codes, -np.round(best, digits)), axis=1)[:, :top_k]
            best, whose = np.take_along_axis(best, first, 1), np.take_along_axis(whose, first, 1)
            at = to
    q, c = np.nonzero(best > -np.inf)
    if len(q):
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(whose[q, c].tolist(), kind), pa.array(best[q, c])], names=["_q", "job_id", "score"])


def _part(average: Column) -> Column:
    """What a document owes to a term, but for the term's weight."""
    tf = F.col("tf")
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / average))


def weigh(index: TermIndex, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(job_id, field, term, part) of the asked terms, and (query_id, field, term, w, most, df).

    A document's score in a field is the sum of w * part over the query's terms; ``most`` is the
    largest that any document gets from the term.
    """
    found, fields = index.look_up(terms)
    fields = F.broadcast(fields)  # one row for each searched field
    rows = found.join(fields, "field").select("job_id", "field", "term", _part(F.col("avg_dl")).alias("part"))
    known = rows.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"), F.max("part").alias("_part"))
    boost = F.element_at(F.create_map(*[F.lit(x) for kv in index.boosts.items() for x in kv]), F.col("field"))
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = terms.join(broadcast_if_small(cut_lineage(known)), ["field", "term"]).join(fields, "field").select(
        "query_id", "field", "term", (idf * boost * F.col("n")).alias("w"), "_part", "df")
    return rows, cut_lineage(weighted.select("query_id", "field", "term", "w", (F.col("w") * F.col("_part")).alias("most"), "df"))


def needed_terms(rows: DataFrame, weighted: DataFrame, top_k: int) -> DataFrame:
    """(query_id, field, term, df) of the terms that bring in every document that can be among a query's best ``top_k``.

    The documents that owe most to each term give a first list, whose last score bounds the
    final one from below.  Of a query's terms in a field, those that together cannot reach it bring no
    document in: only the others are needed.
    """
    by_part = Window.partitionBy("field", "term").orderBy(F.desc("part"), "job_id")
    first = rows.withColumn("_nth", F.row_number().over(by_part)).where(F.col("_nth") <= FIRST_LOOK * top_k).drop("_nth")
    seen = first.join(broadcast_if_small(weighted), ["field", "term"]).groupBy("query_id", "job_id", "field").agg(
        F.sum(F.col("w") * F.col("part")).alias("s")).groupBy("query_id", "job_id").agg(F.max("s").alias("s"))
    order = Window.partitionBy("query_id").orderBy(F.desc("s"), "job_id")
    bound = seen.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= top_k).where(F.col("_rank") == top_k)
    bound = broadcast_if_small(cut_lineage(bound.select("query_id", (F.col("s") - MARGIN).alias("_least"))))
    rising = Window.partitionBy("query_id", "field").orderBy("most", "term").rowsBetween(Window.unboundedPreceding, 0)
    needed = weighted.join(bound, "query_id", "left").withColumn("_together", F.sum("most").over(rising)).where(
        F.col("_least").isNull() | (F.col("_together") >= F.col("_least")))
    return cut_lineage(needed.select("query_id", "field", "term", "df"))


def candidates(rows: DataFrame, needed: DataFrame) -> DataFrame:
    """(job_id, query_id, field) of the documents that hold a needed term of the query."""
    asked = broadcast_if_small(needed.select("query_id", "field", "term"))
    return rows.join(asked, ["field", "term"]).select("job_id", "query_id", "field").distinct()


def score_candidates(rows: DataFrame, weighted: DataFrame, wanted: DataFrame, digits: int = 9) -> DataFrame:
    """(query_id, job_id, score) of the candidates: the best field's sum over the query's terms.

    A candidate meets the asked terms of its own text only, and of those the query's weights.
    """
    theirs = wanted.join(rows, ["job_id", "field"]).join(broadcast_if_small(weighted), ["query_id", "field", "term"])
    return _best_field(theirs, digits)


def _best_field(postings: DataFrame, digits: int) -> DataFrame:
    """(query_id, job_id, score) from (job_id, query_id, field, w, part); sums are combined before their shuffle."""
    sums = postings.groupBy("job_id", "query_id", "field").agg(F.sum(F.col("w") * F.col("part")).alias("s"))
    return sums.groupBy("job_id", "query_id").agg(F.round(F.max("s"), digits).alias("score"))


def top_k_per_query(scored: DataFrame, top_k: int) -> DataFrame:
    """Rank by falling score, then job id; each partition is cut before the shuffle."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("job_id"))
    return (
        scored.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= top_k)
        .select("query_id", "rank", "job_id", "score")
    )
