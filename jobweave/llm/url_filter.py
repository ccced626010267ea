"""URL rules by host suffix and path prefix, matched by an equi join on short hash prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobweave.llm.shared import ascii_lower, small_side, stash

PREFIX_CHARS = 8  # hex characters of the digest that the join compares: 32 bits
DEFAULT_VERDICT = "allow"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; empty without ``://``."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _suffixes(host: Column, most: Column) -> Column:
    """The last 1, 2, ... labels of the host, no more than any rule has."""
    labels = F.split(host, "\\.")
    count = F.least(F.size(labels), most)
    return F.transform(
        F.when(count >= 1, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>")),
        lambda k: F.array_join(F.slice(labels, -k, k), "."),
    )


def _prefixes(path: Column, most: Column, lengths: Column) -> Column:
    """Prefixes of the path that end with a slash, no deeper than any rule, the empty one, and those of the given lengths."""
    parts = F.split(path, "/")
    count = F.least(F.size(parts) - 1, most)
    to_slash = F.transform(
        F.when(count >= 1, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>")),
        lambda k: F.concat(F.array_join(F.slice(parts, 1, k), "/"), F.lit("/")),
    )
    cut = F.transform(F.filter(lengths, lambda n: n <= F.length(path)), lambda n: path.substr(F.lit(1), n))
    return F.array_distinct(F.concat(F.array(F.lit("")), cut, to_slash))


def prepare_rules(rules: DataFrame) -> DataFrame:
    """One row per (host, path) with its digest; where the same rule is given twice, block wins.  Rules
    without a host fit nothing."""
    named = rules.where("host <> ''").select(
        ascii_lower(F.col("host")).alias("_rh"), F.coalesce("path", F.lit("")).alias("_rp"),
        (F.col("action") == "block").alias("_block"),
    ).groupBy("_rh", "_rp").agg(F.max("_block").alias("_block"))
    digest = F.sha2(F.concat("_rh", F.lit("\n"), "_rp"), 256)
    return named.select("*", digest.alias("_digest"), F.substring(digest, 1, PREFIX_CHARS).alias("_short"))


def judge_urls(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """(key, url, host, path, rule, verdict) of every row of ``pages``.

    ``rules`` has host, path and action (allow or block).  A rule fits its host and all
    subdomains where the path starts with the rule's path, with or without a slash at its end.
    The longest fitting rule wins, then the longer host; a URL that no rule fits is allowed.  A null URL, or one without ``://``, has an empty host and path.  Repeated
    rows give repeated results; an empty rule table allows all.

    Each URL row becomes a few expressions; rules are grouped by short prefix, so the join
    yields one row per expression, and one sum per row key brings them back together.
    """
    prepared = stash(prepare_rules(rules), "url_rules")
    by_prefix = prepared.groupBy("_short").agg(F.collect_list(F.struct("_digest", "_rh", "_rp", "_block")).alias("_rules"))
    # No rule is longer than labels and depth, so longer expressions cannot fit; a rule path that ends
    # inside a name can only be met by a prefix of its length.
    inside = ~F.col("_rp").endswith("/") & (F.col("_rp") != "")
    longest = prepared.agg(
        F.coalesce(F.max(F.size(F.split("_rh", "\\."))), F.lit(0)).alias("labels"),
        F.coalesce(F.max(F.size(F.split("_rp", "/"))), F.lit(0)).alias("depth"),
        F.collect_set(F.when(inside, F.length("_rp"))).alias("lengths"),
    ).first()
    lengths = F.array(*[F.lit(n) for n in longest.lengths]).cast("array<int>")
    rows = pages.select(F.col(key).alias("_key"), F.col(url).alias("_url")).withColumns(
        {"_host": host_of(F.col("_url")), "_path": path_of(F.col("_url"))})
    hosts, paths = _suffixes(F.col("_host"), F.lit(longest.labels)), _prefixes(F.col("_path"), F.lit(longest.depth), lengths)
    pairs = F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.struct(h.alias("h"), p.alias("p")))))
    rows = rows.withColumn("_pairs", pairs).withColumn("_count", F.greatest(F.size("_pairs"), F.lit(1)))
    each = rows.select("_key", "_url", "_host", "_path", "_count", F.explode_outer("_pairs").alias("_pair"))
    each = each.withColumn("_full", F.sha2(F.concat("_pair.h", F.lit("\n"), "_pair.p"), 256))
    each = each.withColumn("_short", F.substring("_full", 1, PREFIX_CHARS)).drop("_pair")
    joined = each.join(small_side(stash(by_prefix, "url_rules_by_prefix")), "_short", "left")
    fit = F.get(F.filter("_rules", lambda r: r["_digest"] == F.col("_full")), F.lit(0))
    best = F.when(fit.isNotNull(), F.struct(
        F.length(F.concat(fit["_rh"], fit["_rp"])).alias("length"), F.length(fit["_rh"]).alias("host_length"),
        F.concat(fit["_rh"], fit["_rp"]).alias("rule"), fit["_block"].alias("block"),
    ))
    # Equal rows of pages meet in one group; their number is the rows over the expressions of one.
    found = joined.select("_key", "_url", "_host", "_path", "_count", best.alias("_best")).groupBy(
        "_key", "_url", "_host", "_path").agg(F.max("_best").alias("_best"), (F.count(F.lit(1)) / F.first("_count")).cast("int").alias("_times"))
    found = found.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    verdict = F.when(F.col("_best").isNull(), F.lit(DEFAULT_VERDICT)).otherwise(
        F.when(F.col("_best.block"), F.lit("block")).otherwise(F.lit("allow")))
    return found.select(
        F.col("_key").alias(key), F.col("_url").alias(url), F.col("_host").alias("host"), F.col("_path").alias("path"),
        F.col("_best.rule").alias("rule"), verdict.alias("verdict"),
    )
