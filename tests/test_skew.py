"""Hot keys: same results, no task with the whole key."""

from pyspark.sql import functions as F

from jobweave.operators import dedup, skew


def hot_table(spark, n=20000):
    """A third of all rows share one key; a NULL key is frequent too."""
    k = F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 7 == 0, None).otherwise((F.col("id") % 500).cast("string"))
    return spark.range(n).withColumn("k", k)


def test_attach_by_key_equals_a_plain_join(spark):
    rows = hot_table(spark)
    per_key = rows.where("k IS NULL OR k <> '5'").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("m"))
    right = per_key.select(F.col("k").alias("k2"), "n", "m")
    for how in ("left", "inner"):
        want = rows.join(right, F.col("k").eqNullSafe(F.col("k2")), how).select("id", "k", "n", "m")
        got = skew.attach_by_key(rows, per_key, ["k"], "n", "id", how)
        assert got.count() == want.count() and got.exceptAll(want).isEmpty()


def test_attach_by_key_spreads_the_hot_key(spark):
    rows = hot_table(spark)
    per_key = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = skew.attach_by_key(rows, per_key, ["k"], "n", "id")
        sizes = joined.groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert max(r["count"] for r in sizes) < 20000 / 4


def test_newest_per_key_cuts_before_the_shuffle(spark):
    rows = hot_table(spark).select("id", F.lit("c").alias("company"), F.col("k").alias("title"), F.lit(None).cast("timestamp").alias("created_at"))
    plan = dedup.newest_per_key(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_newest_per_key_null_time_is_newest(spark):
    rows = spark.createDataFrame([
        (1, "A", "Dev", "2024-01-01"), (2, "A", "dev", "2024-02-01"), (3, "A", "DEV", None), (4, "a", "dev", "2020-01-01"),
    ], "id int, company string, title string, created_at string").withColumn("created_at", F.col("created_at").cast("timestamp"))
    assert sorted(r.id for r in dedup.newest_per_key(rows).collect()) == [3, 4]


def test_reposts_match_a_batch_loop(spark):
    import random

    random.seed(5)
    rows, stored, want = [], [], {}
    for i in range(600):
        batch, key, at = i // 20, random.choice("abcdefghijklmnopqrstuvwxyz"), random.choice([None, f"2024-01-{random.randint(1, 28):02d}"])
        rows.append((i, batch, "Co", key.upper() if i % 2 else key, at))
    for b in range(30):
        now = [r for r in rows if r[1] == b]
        for r in now:
            same = sorted((s for s in stored if s[3].lower() == r[3].lower()), key=lambda s: (s[1], s[4] is None, s[4] or "", s[0]))
            want[r[0]] = same[0][0] if same else None
        stored += now
    df = spark.createDataFrame(rows, "id int, batch_no long, company string, title string, created_at string").withColumn("created_at", F.col("created_at").cast("timestamp"))
    got = {r.id: r.original_job_id for r in dedup.tag_reposts(df).collect()}
    assert got == want


def test_alternate_listings_of_a_request(spark):
    rows = spark.createDataFrame([
        (1, "s1", "u1", "Dev", "Acme"), (2, "s2", "u2", "dev", "ACME"), (3, "s1", "u3", "DEV", "acme"), (4, "s2", "u4", "Ops", "Acme"),
    ], "id int, source string, url string, title string, company string")
    got = dedup.alternate_listings(rows, spark.createDataFrame([(1,), (4,)], "job_id int"))
    assert {(r.job_id, r.id) for r in got.collect()} == {(1, 2)}


def test_fits_broadcast(spark):
    df = spark.range(1000)
    assert skew.fits_broadcast(df) and not skew.fits_broadcast(df, max_rows=999) and not skew.fits_broadcast(df, max_bytes=1000)
