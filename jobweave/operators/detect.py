"""Dictionary terms in free text, found with an equi join instead of one regex per term.

A term counts where it starts at the text start or right after a delimiter and ends at the
text end or right before one.  Every such stretch is a run of pieces between delimiters
with the delimiters inside it kept, so the stretches of a text can be listed and looked up
in a hash table of the dictionary.  Work is linear in the text instead of text x terms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobweave import fixed_values as fv
from jobweave.functions.text import all_skills, no_strings, present, tokenize, with_once
from jobweave.operators.skew import broadcast_if_small, rows_with_keys, spread_if_few
from jobweave.session import cut_lineage

_DELIMITER = "(?U)" + fv.TERM_DELIMITERS
NESTED = 4  # pieces of the longest run that is made from a shorter one


def _pieces(text: Column) -> Column:
    return F.split(text, _DELIMITER, -1)


def piece_counts(dictionary: DataFrame, term: str = "skill") -> list[int]:
    """The numbers of pieces the terms have: a handful of small integers."""
    rows = dictionary.select(F.size(_pieces(F.lower(term))).alias("n")).distinct().orderBy("n").collect()
    return [r.n for r in rows]


def spans(text: Column, counts: list[int]) -> Column:
    """Distinct delimited stretches of the lower-cased text, of the given piece counts."""
    low = F.lower(F.coalesce(text, F.lit("")))
    marks = F.regexp_extract_all(low, F.lit(f"({_DELIMITER})"), 1) if counts != [1] else no_strings()
    # The cut text is bound to a lambda variable, so that it is cut once and not per run.
    cut = F.array(F.struct(_pieces(low).alias("pieces"), marks.alias("marks")))

    def with_longer(row: Column, n: int, runs: Column, most: int) -> Column:
        """Runs of ``n`` pieces, if asked for, and of more: those of one more are these, each with the mark and the piece that follow."""
        own = runs if n in counts else no_strings()
        if n >= most:
            return own
        room = F.greatest(F.size(row["pieces"]) - n, F.lit(0))
        marked = F.zip_with(F.slice(runs, 1, room), F.slice(row["marks"], n, room), lambda run, mark: F.concat(run, mark))
        longer = F.zip_with(marked, F.slice(row["pieces"], n + 1, room), lambda run, piece: F.concat(run, piece))
        return F.concat(own, with_once(longer, lambda some: with_longer(row, n + 1, some, most)))

    def of_length(row: Column, n: int) -> Column:
        last = F.size(row["pieces"]) - n

        def run_at(i: Column) -> Column:
            following = [part for j in range(1, n) for part in (F.get(row["marks"], i + (j - 1)), F.get(row["pieces"], i + j))]
            return F.concat(F.get(row["pieces"], i), *following)

        return F.when(
            last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), run_at)
        ).otherwise(no_strings())

    # Short runs are made from each other, longer ones, which would nest too deeply, from their pieces.
    short = max([n for n in counts if n <= NESTED], default=1)
    every = lambda row: F.concat(with_longer(row, 1, row["pieces"], short), *[of_length(row, n) for n in counts if n > NESTED])
    return F.array_distinct(F.flatten(F.transform(cut, every)))


def _made_once(rows: DataFrame, **columns: Column) -> DataFrame:
    """``rows`` with more columns, each made once in a row.

    An explode brings a filter on what it explodes, which would be pushed below and make it again; it
    cannot pass the one-element explode here.
    """
    made = F.explode(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))).alias("_made")
    return rows.select("*", made).select(*rows.columns, "_made.*")


def lookup_table(dictionary: DataFrame, term: str = "skill") -> DataFrame:
    """(span, term): distinct terms by lower-case form; blank terms are left out."""
    return dictionary.where(present(F.trim(term))).select(F.lower(term).alias("span"), F.col(term).alias("term")).distinct()


def detect_terms(texts: DataFrame, dictionary: DataFrame, *, key: str = "id", text: str = "text", term: str = "skill") -> DataFrame:
    """Distinct (key, term) for every dictionary term that occurs in the text.

    Spans are distinct per text, so the result needs no shuffle when the dictionary is
    small enough to broadcast; otherwise both sides shuffle on the span.
    """
    counts = piece_counts(dictionary, term)
    rows = _made_once(spread_if_few(texts.select(key, text)), _spans=spans(F.col(text), counts))
    stretches = rows.select(key, F.explode("_spans").alias("span"))
    return stretches.join(broadcast_if_small(lookup_table(dictionary, term)), "span").select(key, "term")


def detect_skills(postings: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(job_id, skill_name, source_field) for skills named in the text but not listed.

    The title wins over the description; both are cut into spans in the same row, so this
    too is one map-side join.
    """
    counts = piece_counts(dictionary)
    needed = spread_if_few(postings.select("id", "title", "description", "skills_required", "skills_nice_to_have"))
    rows = _made_once(
        needed.withColumnRenamed("id", "job_id"), _listed=F.transform(all_skills(), lambda s: F.lower(s)),
        _in_title=spans(F.col("title"), counts), _in_text=spans(F.col("description"), counts),
    ).select("job_id", F.array_except("_in_title", "_listed").alias("_title"), F.array_except("_in_text", F.concat("_listed", "_in_title")).alias("_text"))
    # Only the stretches themselves become rows; those before ``_titled`` are the title's.
    rows = _made_once(rows.select("job_id", F.size("_title").alias("_titled"), "_title", "_text"), _every=F.concat("_title", "_text"))
    tagged = rows.select("job_id", "_titled", F.posexplode("_every").alias("_at", "span"))
    return tagged.join(broadcast_if_small(lookup_table(dictionary)), "span").select(
        "job_id", F.col("term").alias("skill_name"),
        F.when(F.col("_at") < F.col("_titled"), "title").otherwise("description").alias("source_field"),
    )


def undetected(postings: DataFrame, processed: DataFrame) -> DataFrame:
    """Postings whose id is not among the processed ones."""
    return postings.join(processed.select(F.col("job_id").alias("id")).distinct(), "id", "left_anti")


def detect_missing(postings: DataFrame, processed: DataFrame, dictionary: DataFrame) -> DataFrame:
    return detect_skills(undetected(postings, processed), dictionary)


def upsert_detected(stored: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of ``found`` to append: new (job_id, skill_name) pairs, once each."""
    pair = ["job_id", "skill_name"]
    known = rows_with_keys(stored.select(*pair), found, ["job_id"])
    return found.dropDuplicates(pair).join(known, pair, "left_anti")


def detected_of(detected: DataFrame, job_ids: DataFrame) -> DataFrame:
    """Stored skills of the requested jobs, sorted by name within a job."""
    return (
        detected.join(broadcast_if_small(job_ids.select("job_id")), "job_id", "left_semi")
        .select("job_id", "skill_name", "source_field").orderBy("job_id", "skill_name")
    )


def keywords(texts: DataFrame, dictionary: DataFrame, *, key: str = "resume_id", text: str = "text") -> DataFrame:
    """Distinct (key, keyword): word tokens and the dictionary terms found in the text.

    Words and stretches of a text are made distinct in its row, and a stretch meets all spellings of its term at once,
    so the keywords of a text are distinct without a shuffle.  Only texts that share their key with another go through one.
    """
    counts = piece_counts(dictionary)
    looked_up = broadcast_if_small(lookup_table(dictionary).groupBy("span").agg(F.collect_list("term").alias("_terms")))

    def found(some: DataFrame) -> DataFrame:
        rows = _made_once(some, _tokens=tokenize(F.col(text)), _spans=spans(F.col(text), counts))
        # First the words that are no stretch, then those that are, then the other stretches.
        rows = _made_once(
            rows.select(key, "_tokens", "_spans"), _alone=F.array_except("_tokens", "_spans"),
            _also=F.array_intersect("_tokens", "_spans"), _other=F.array_except("_spans", "_tokens"))
        every = F.concat("_alone", "_also", "_other")
        each = rows.select(key, F.size("_alone").alias("_alone"), F.size("_tokens").alias("_words"), F.posexplode(every).alias("_at", "span"))
        word = F.when(F.col("_at") < F.col("_words"), F.array("span")).otherwise(no_strings())
        terms = F.when(F.col("_at") >= F.col("_alone"), F.col("_terms"))
        return each.join(looked_up, "span", "left").select(key, F.explode(F.array_union(word, F.coalesce(terms, no_strings()))).alias("keyword"))

    times = texts.groupBy(key).agg(F.count(F.lit(1)).alias("_times"))
    shared = cut_lineage(times.where("_times > 1").select(F.col(key).alias("_key")))
    needed = spread_if_few(texts.select(key, text))
    if shared.isEmpty():
        return found(needed)
    marked = broadcast_if_small(shared)
    on = F.col(key).eqNullSafe(F.col("_key"))
    return found(needed.join(marked, on, "left_anti")).unionByName(found(needed.join(marked, on, "left_semi")).distinct())
