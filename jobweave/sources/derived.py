"""Posting-shaped views of the given tables (orders, lineitem, documents, events, ...).

The tables hold no postings, so orders and customers play that part; documents play
postings with long text.  Each view is a plain lazy DataFrame: unused columns and the
joins behind them are pruned by the optimizer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_skills(spark: SparkSession, sf_dir: str, distinct: bool = True) -> DataFrame:
    """(l_orderkey, req, nice): words of the part names, part types.

    (order, part name, part type) is made distinct before the lists are gathered, so a
    list is bounded by the vocabulary and not by the lines of an order.
    """
    lines = table(spark, sf_dir, "lineitem").join(
        table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")
    )
    if distinct:
        lines = lines.select("l_orderkey", "p_name", "p_type").distinct()
        words = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.split("p_name", " ")))))
        types = F.array_sort(F.collect_set("p_type"))
    else:
        words = F.array_sort(F.flatten(F.collect_list(F.split("p_name", " "))))
        types = F.array_sort(F.collect_list("p_type"))
    return lines.groupBy("l_orderkey").agg(words.alias("req"), types.alias("nice"))


def postings(
    spark: SparkSession, sf_dir: str, *, skills: bool = False, repeated_skills: bool = False, described: bool = False
) -> DataFrame:
    """One posting per order."""
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer")
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    base = (
        o.join(c, o.o_custkey == c.c_custkey)
        .join(n, c.c_nationkey == n.n_nationkey)
        .join(r, n.n_regionkey == r.r_regionkey)
    )
    none = F.array().cast("array<string>")
    if skills or repeated_skills:
        sk = order_skills(spark, sf_dir, distinct=not repeated_skills)
        base = base.join(sk, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        req, nice = F.coalesce("req", none), F.coalesce("nice", none)
    else:
        req = nice = none
    if described:
        docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("_doc"), F.col("text").alias("_text"))
        base = base.join(docs, F.col("o_orderkey") == F.col("_doc"), "left")
        description = F.col("_text")
    else:
        description = F.lit(None).cast("string")
    k = F.col("o_orderkey")
    source = F.concat(F.lit("src"), (k % 3).cast("string"))
    pay = F.when(k % 6 == 0, F.col("o_totalprice") / 1000).otherwise(F.col("o_totalprice"))
    return base.select(
        k.alias("id"),
        F.concat(F.lit("https://"), source, F.lit(".example/job/"), k.cast("string")).alias("url"),
        source.alias("source"),
        F.concat_ws(" ", "c_mktsegment", "o_orderpriority").alias("title"),
        F.col("c_name").alias("company"),
        F.array("n_name", "r_name").alias("location"),
        F.when(k % 11 != 0, pay).alias("salary_min"),
        F.when((k % 11 != 0) & (k % 4 != 0), pay * 1.25).alias("salary_max"),
        F.element_at(F.array(*[F.lit(x) for x in ("PLN", "USD", "EUR", "GBP", "XYZ")]), (k % 5 + 1).cast("int"))
        .alias("salary_currency"),
        F.when(k % 9 == 0, "100 PLN/h").when(k % 9 == 1, "500/day").when(k % 9 == 2, "B2B")
        .when(k % 9 == 3, "Permanent").alias("salary_type"),
        req.alias("skills_required"),
        nice.alias("skills_nice_to_have"),
        F.when(k % 2 == 0, F.array(F.lit("B2B"))).alias("employment_types"),
        F.col("o_orderpriority").alias("seniority"),
        F.when(k % 7 == 0, None).when(k % 3 == 0, "Remote").when(k % 3 == 1, "Hybrid").otherwise("Onsite")
        .alias("work_type"),
        F.col("c_mktsegment").alias("category"),
        (k % 10 == 0).alias("is_reposted"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date_added"),
        F.col("o_orderstatus").alias("status"),
        (k % 13 == 0).alias("saved"),
        F.col("o_orderdate").alias("created_at"),
        description.alias("description"),
    )


def salaried(spark: SparkSession, sf_dir: str, **kw) -> DataFrame:
    """Postings with their monthly PLN range."""
    from jobweave.functions.salary import normalize_salary

    return normalize_salary(postings(spark, sf_dir, **kw))


def text_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One posting per document: its text is the description, its first words are skills."""
    # The first two runs of two or more letters; the match ends there, whatever the length.
    pattern = r"^[\s\S]*?(\p{L}{2,})(?:[^\p{L}][\s\S]*?(\p{L}{2,}))?"
    found = F.array(F.regexp_extract("text", pattern, 1), F.regexp_extract("text", pattern, 2))
    words = F.filter(found, lambda w: w != "")
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        F.concat(F.lit("https://"), F.col("source"), F.lit(".example/doc/"), F.col("doc_id").cast("string")).alias("url"),
        F.col("source"),
        F.element_at(F.split("text", r"\n"), 1).alias("title"),
        F.concat_ws("-", "source", "lang").alias("company"),
        F.col("lang").alias("category"),
        words.alias("skills_required"),
        F.array_except(F.array(F.array_join(words, " ")), F.array(F.lit(""))).alias("skills_nice_to_have"),
        F.col("text").alias("description"),
    )


def inference_log_of(events: DataFrame) -> DataFrame:
    """Events read as model calls; every seventh has no latency."""
    k = F.col("event_id")
    return events.select(
        F.col("ts").alias("created_at"),
        F.col("event_type").alias("model"),
        F.when(k % 7 != 0, F.floor("value")).cast("bigint").alias("latency_ms"),
        F.get_json_object("props", "$.k").cast("bigint").alias("input_tokens"),
        F.when(k % 5 != 0, k % 50).alias("output_tokens"),
        F.col("user_id"),
    )


def inference_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inference_log_of(table(spark, sf_dir, "events"))


def resumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One resume per customer (resume_id, skill): the words, in upper case, and the type of
    the part that has the customer's number."""
    people = table(spark, sf_dir, "customer").join(
        table(spark, sf_dir, "part"), F.col("c_custkey") == F.col("p_partkey")
    )
    words = F.explode(F.concat(F.transform(F.split("p_name", " "), lambda w: F.upper(w)), F.array("p_type")))
    return people.select(F.col("c_custkey").alias("resume_id"), words.alias("skill"))
