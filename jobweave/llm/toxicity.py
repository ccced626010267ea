"""Toxicity by a chain of linear models, each fed the probabilities of the categories before it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobweave.llm.shared import small_side, stash


@dataclass(frozen=True)
class ChainSettings:
    """``max_labelled`` bounds the sample of labelled rows that the models are fitted on: those with
    the smallest hashes of their keys.  A word becomes a feature if ``min_documents`` of them hold it."""

    max_labelled: int = 20_000
    folds: int = 3
    vocabulary: int = 1 << 16
    min_documents: int = 5
    ridge: float = 1e-4
    iterations: int = 40
    threshold: float = 0.4


@dataclass(frozen=True)
class Chain:
    """``rates`` stand in for the models where no word was frequent enough to learn from."""

    categories: tuple[str, ...]
    words: CountVectorizerModel | None
    models: tuple[LogisticRegressionModel, ...]
    threshold: float
    rates: tuple[float, ...] = ()


STEM = 5
ROWS_PER_TASK = 5_000  # labelled rows that a task of a fit reads


def words_of(text: Column) -> Column:
    """The different words of letters, in lower case, and the stems of longer ones, marked as such."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("\\p{L}+"), F.lit(0)))
    long = F.filter(words, lambda w: F.length(w) > STEM)
    return F.concat(words, F.array_distinct(F.transform(long, lambda w: F.concat(F.substring(w, 1, STEM), F.lit("-")))))


def _with_features(df: DataFrame, categories: tuple[str, ...]) -> DataFrame:
    """``_x``: word counts and the probabilities of earlier categories."""
    if not categories:
        return df.withColumn("_x", F.col("_words"))
    return VectorAssembler(inputCols=["_words", *[f"p_{c}" for c in categories]], outputCol="_x").transform(df)


def _apply(df: DataFrame, model: LogisticRegressionModel, category: str) -> DataFrame:
    scored = model.transform(df)
    return scored.withColumn(f"p_{category}", vector_to_array("_probability")[1]).drop("_x", "_raw", "_probability", "_predicted")


def train_chain(
    docs: DataFrame, labels: DataFrame, categories: tuple[str, ...], key: str = "doc_id", text: str = "text",
    settings: ChainSettings | None = None,
) -> Chain:
    """Fit one logistic model for each category, in order.

    ``labels`` has the key and a 0/1 column for each category; rows with a null are left out,
    of several rows for a key the largest labels count.  Each model but the last also predicts its
    category for rows outside its folds: these out-of-fold probabilities, not those a model gives to
    its own training rows, are what later models learn from.

    A null text or key is left out, an empty text has no words, a very long one all its words;
    repeated documents count each time.  Where no word is in ``min_documents`` labelled texts, each
    category gets its share among them; without any labelled text the chain scores 0.  Other
    columns of both tables are left behind, whatever their names.
    """
    settings = settings or ChainSettings()
    named = labels.select(F.col(key).alias("_key"), *[F.col(c).cast("double").alias(c) for c in categories]).dropna()
    named = named.groupBy("_key").agg(*[F.max(c).alias(c) for c in categories])
    named = named.withColumn("_hash", F.xxhash64("_key")).orderBy("_hash", "_key").limit(settings.max_labelled)
    named = small_side(stash(named.withColumn("_fold", F.pmod(F.xxhash64(F.col("_key"), F.lit(1)), F.lit(settings.folds))), "labelled"))
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).where("_text is not null").join(named, "_key")
    rows = stash(rows.select("_fold", *categories, words_of(F.col("_text")).alias("_tokens")), "labelled_words")
    if rows.isEmpty():
        return Chain(categories, None, (), settings.threshold)
    shared = rows.select(F.explode("_tokens").alias("_w")).groupBy("_w").count().where(F.col("count") >= settings.min_documents)
    if shared.isEmpty():
        rates = rows.agg(*[F.avg(c).alias(c) for c in categories]).first()
        return Chain(categories, None, (), settings.threshold, tuple(rates))
    vectorizer = CountVectorizer(inputCol="_tokens", outputCol="_words", vocabSize=settings.vocabulary, minDF=settings.min_documents, binary=True)
    words = vectorizer.fit(rows)
    # Every step of a fit is a job over these rows; their number is bounded, and so is that of their tasks.
    tasks = -(-settings.max_labelled // ROWS_PER_TASK)
    train = stash(words.transform(rows).drop("_tokens"), "labelled_features").coalesce(tasks)
    models: list[LogisticRegressionModel] = []
    for at, category in enumerate(categories):
        learner = LogisticRegression(
            featuresCol="_x", labelCol=category, probabilityCol="_probability", rawPredictionCol="_raw", predictionCol="_predicted",
            regParam=settings.ridge, maxIter=settings.iterations, standardization=False, family="binomial")
        rows = _with_features(train, categories[:at])
        models.append(learner.fit(rows))
        if at + 1 < len(categories):
            held = [r._fold for r in rows.select("_fold").distinct().orderBy("_fold").collect()]  # at most ``folds``
            if len(held) == 1:  # nothing lies outside the only fold
                parts = [rows.withColumn(f"p_{category}", F.lit(rows.agg(F.avg(category)).first()[0])).drop("_x")]
            else:
                parts = [_apply(rows.where(F.col("_fold") == k), learner.fit(rows.where(F.col("_fold") != k)), category) for k in held]
            out = parts[0]
            for part in parts[1:]:
                out = out.unionByName(part)
            train = stash(out, "labelled_chained").coalesce(tasks)
    return Chain(categories, words, tuple(models), settings.threshold)


def score_chain(docs: DataFrame, chain: Chain, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, p_<category> ..., flagged) of every document; flagged by the last category.

    All words of the text count, however long it is.  A null or empty text scores like one without words.
    Without any labelled document all probabilities are 0.  Repeated rows get the same scores; an
    empty table gives none, and other columns are left behind.
    """
    probabilities = [f"p_{c}" for c in chain.categories]
    rows = docs.select(F.col(key).alias("_key"), words_of(F.col(text)).alias("_tokens"))
    if chain.words is None:
        rates = chain.rates or (0.0,) * len(probabilities)
        rows = rows.withColumns({p: F.lit(float(r)) for p, r in zip(probabilities, rates)})
    else:
        rows = chain.words.transform(rows)
        for at, (category, model) in enumerate(zip(chain.categories, chain.models)):
            rows = _apply(_with_features(rows, chain.categories[:at]), model, category)
    return rows.select(F.col("_key").alias(key), *probabilities, (F.col(probabilities[-1]) >= chain.threshold).alias("flagged"))
