"""Filling postings without a description from their stored pages."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobweave.operators.detect import detect_skills
from jobweave.operators.skew import rows_with_keys
from jobweave.operators.skills import known_skills
from jobweave.plans.changes import enrichment_backlog, merge_enrichment
from jobweave.plans.ingest import too_long
from jobweave.session import cut_lineage, keep
from jobweave.sources.pages import parse_pages, source_of


@dataclass(frozen=True)
class Enrichment:
    postings: DataFrame   # all postings, with a flag ``enriched``
    detected: DataFrame   # skills found in the enriched ones
    errors: DataFrame     # url, error


def enrich_backfill(postings: DataFrame, pages: DataFrame, limit: int | None = None) -> Enrichment:
    """``pages``: url, html of fetched offers.  ``limit``, if given, is the size of one run.

    Backlog, parsed pages and merged postings are read several times, so each is kept once it is made.
    """
    backlog = keep(enrichment_backlog(postings, source_of(F.col("url")).isNotNull(), limit))
    parsed, rejected = parse_pages(rows_with_keys(pages, backlog, ["url"]))
    parsed = keep(parsed)
    merged = keep(merge_enrichment(postings, parsed))
    absent = backlog.join(parsed.select("url"), "url", "left_anti").select("url", F.lit("no page").alias("error"))
    found = detect_skills(merged.where("enriched"), cut_lineage(known_skills(merged)))
    return Enrichment(merged, found, rejected.unionByName(absent).unionByName(too_long(parsed).drop("source")))
