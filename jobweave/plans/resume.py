"""Resume texts to skills, matching postings and category scores."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from jobweave import fixed_values as fv
from jobweave.operators import detect, skills
from jobweave.session import cut_lineage


@dataclass(frozen=True)
class ResumeAnalysis:
    skills: DataFrame       # resume_id, skill
    matches: DataFrame      # see skills.match_postings
    categories: DataFrame   # see skills.category_scores
    to_add: DataFrame       # see skills.skills_to_add


def analyze_resumes(
    texts: DataFrame, postings: DataFrame, extra_keywords: DataFrame | None = None, limit: int = fv.MATCH_LIMIT
) -> ResumeAnalysis:
    """``texts``: resume_id, text.  ``extra_keywords``: resume_id, keyword, from elsewhere.

    The skills are read by three results, so they are kept once found.
    """
    known = cut_lineage(skills.known_skills(postings))
    words = detect.keywords(texts, known)
    if extra_keywords is not None:
        words = skills.with_extra_keywords(words, extra_keywords)
    found = cut_lineage(skills.canonical_resume_skills(words, known))
    return ResumeAnalysis(
        found, skills.match_postings(postings, found, limit=limit),
        skills.category_scores(postings, found), skills.skills_to_add(postings, found),
    )
