"""Spelling variants: words one edit apart, found by composing automata.

The minimal acceptor of the vocabulary is composed with a transducer that makes one edit, and with
the acceptor again.  Before its edit a path of the composition reads one word twice, so it is in
one state of the acceptor; after it, two states read the same letters to the end.  The
accepted pairs are enumerated in partitions that fix what lies before and after the places where
the edit may be: the letters before name the state in which a partition starts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobweave.llm.shared import ascii_lower, small_side, stash
from jobweave.operators.skew import task_count

LETTERS = "[a-zÀ-ÿ]+"  # after A-Z have become a-z
CELL_WORDS = 20_000
PAIRS_AT_ONCE = 50_000
CELL = ["length", "first", "last", "before", "after"]


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", drop_one_in: int | None = None) -> DataFrame:
    """(word, n): letter runs of all texts, in lower case (A-Z only), with their number.

    With ``drop_one_in`` a run loses a letter where that number divides the CRC of ``<key>:<run>``:
    the one at the place that the CRC leaves modulo the run's length.  A null text has no runs, a null
    key counts as an empty one; repeated rows count each time.  An empty table gives no words.
    """
    runs = docs.select(
        F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).alias("_key"),
        F.explode(F.regexp_extract_all(ascii_lower(F.col(f"`{text}`")), F.lit(LETTERS), F.lit(0))).alias("_run"))
    word = F.col("_run")
    if drop_one_in is not None:
        runs = runs.withColumn("_h", F.crc32(F.concat("_key", F.lit(":"), "_run").cast("binary")))
        at = (F.col("_h") % F.char_length("_run")).cast("int")
        shorter = F.concat(F.col("_run").substr(F.lit(1), at), F.col("_run").substr(at + 2, F.char_length("_run")))
        word = F.when(F.col("_h") % drop_one_in == 0, shorter).otherwise(F.col("_run"))
    return runs.select(word.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


class Acceptor:
    """The minimal acceptor of some words, given sorted and different.

    States are numbered so that every arc leads to a smaller number.  Each arc counts the words
    that come before those through it, so that a path adds up to its word's place in the list.
    """

    def __init__(self, words: list[str]):
        register: dict[tuple, int] = {}
        self.final: list[bool] = []
        self.arcs: list[dict[str, tuple[int, int]]] = []  # letter -> (state, words before)
        self.counts: list[int] = []
        path: list[list] = [[False, []]]
        last = ""
        for word in words:
            same = 0
            while same < len(last) and same < len(word) and last[same] == word[same]:
                same += 1
            self._close(path, last, same, register)
            path += [[False, []] for _ in word[same:]]
            path[-1][0] = True
            last = word
        self._close(path, last, 0, register)
        self.start = self._state(path[0], register)
        self._shared: dict[tuple[int, int], list[tuple[int, int]]] = {}

    def _close(self, path: list, word: str, to: int, register: dict) -> None:
        """Finish the states of the last word below depth ``to``; one equal to an earlier state becomes that."""
        for depth in range(len(word), to, -1):
            done = self._state(path.pop(), register)
            path[-1][1].append((word[depth - 1], done))

    def _state(self, node: list, register: dict) -> int:
        shape = (node[0], tuple(node[1]))
        found = register.get(shape)
        if found is None:
            found = register[shape] = len(self.arcs)
            passed, arcs = int(node[0]), {}
            for letter, to in node[1]:
                arcs[letter] = (to, passed)
                passed += self.counts[to]
            self.final.append(node[0])
            self.arcs.append(arcs)
            self.counts.append(passed)
        return found

    def shared(self, p: int, q: int) -> list[tuple[int, int]]:
        """Endings that both states accept, as their places among the words from either state."""
        if p == q:
            return [(i, i) for i in range(self.counts[p])]
        known, todo = self._shared, [(p, q)]
        while todo:
            pair = todo[-1]
            if pair in known:
                todo.pop()
                continue
            a, b = self.arcs[pair[0]], self.arcs[pair[1]]
            steps = [(a[c], b[c]) for c in (a if len(a) <= len(b) else b) if c in a and c in b]
            waiting = [(s[0], t[0]) for s, t in steps if s[0] != t[0] and (s[0], t[0]) not in known]
            if waiting:
                todo += waiting
                continue
            found = [(0, 0)] if self.final[pair[0]] and self.final[pair[1]] else []
            for (s, x), (t, y) in steps:
                if s == t:
                    found += [(x + i, y + i) for i in range(self.counts[s])]
                else:
                    found += [(x + i, y + j) for i, j in known[s, t]]
            known[pair] = found
            todo.pop()
        return known[p, q]

    def edits(self, q: int, at_end: bool) -> list[tuple[int, int]]:
        """Pairs of endings from state ``q`` whose first letters differ and that one edit here makes equal.

        The second of an inserted letter's pair is the longer.  ``at_end`` lets a letter be added behind the first's end.
        """
        arcs = list(self.arcs[q].items())
        found = []
        for k, (c, (s, x)) in enumerate(arcs):
            for _, (t, y) in arcs[k + 1:]:
                found += [(x + i, y + j) for i, j in self.shared(s, t)]
            # c put before what the first word goes on with, which begins otherwise.
            after = self.arcs[s]
            if at_end and self.final[q] and self.final[s]:
                found.append((0, x))
            for d, (t, y) in arcs:
                if d != c and d in after:
                    u, z = after[d]
                    found += [(y + i, x + z + j) for i, j in self.shared(t, u)]
        return found

    def pairs(self, at_end: bool) -> Iterator[tuple[int, int]]:
        """Places of all pairs of words that the composition accepts, each once."""
        ways: list[list[int]] = [[] for _ in self.arcs]
        ways[self.start].append(0)
        for q in range(self.start, -1, -1):
            if not ways[q]:
                continue
            arcs = self.arcs[q]
            for to, passed in arcs.values():
                ways[to] += [w + passed for w in ways[q]]
            if len(arcs) > 1 or arcs and self.final[q]:
                for i, j in self.edits(q, at_end):
                    yield from ((w + i, w + j) for w in ways[q])
            ways[q] = []


def _pairs_in_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of each cell; the rows of a cell come one after another."""
    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*[c.to_pylist() for c in batch.columns])

    def cell(row: tuple) -> tuple:
        length, first, last, word, _ = row
        return length, first, last, word[:first], word[len(word) - max(length - last, 0):]

    def out() -> pa.RecordBatch:
        columns = [pa.array([p[k] for p in found], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, names=["word", "near", "near_n"])

    found: list[tuple[str, str, int]] = []
    for (length, first, last, _, after), group in groupby(rows(), cell):
        words = sorted((r[3][first:len(r[3]) - len(after)], r[3], r[4]) for r in group)
        if len(words) < 2:
            continue
        for i, j in Acceptor([w[0] for w in words]).pairs(at_end=last > length):
            (_, u, n), (_, v, m) = words[i], words[j]
            if len(u) == length:  # two words that are both longer meet in the cells of their own length
                found += [(u, v, m), (v, u, n)]
                if len(found) >= PAIRS_AT_ONCE:
                    yield out()
                    found.clear()
    yield out()


def _with_cells(rows: DataFrame) -> DataFrame:
    """Letters before and after the places ``first`` to ``last`` - 1 of an edit, counted in the shorter word."""
    after = F.greatest(F.col("length") - F.col("last"), F.lit(0))
    return rows.withColumns({
        "before": F.col("word").substr(F.lit(1), F.col("first")),
        "after": F.col("word").substr(F.char_length("word") - after + 1, after)})


def _halves(first: Column, last: Column) -> Column:
    middle = F.floor((first + last) / 2).cast("int")
    return F.array(F.struct(first.alias("first"), middle.alias("last")), F.struct(middle.alias("first"), last.alias("last")))


def near_pairs(words: DataFrame, cell_words: int = CELL_WORDS) -> DataFrame:
    """(word, near, near_n): all words exactly one edit apart, in both directions; ``words`` has different words with n.

    A word of length k meets words of its length and those one longer in cells of length k, and
    shorter ones in cells of length k - 1.  An edit is in the first or in the second half of a
    word, so a cell holds the words that agree in the other half.  A cell of more than
    ``cell_words`` words is halved again, in the end down to one place, where the alphabet bounds it:
    no cell grows with the data, whatever the words share.
    """
    length = F.explode(F.array(F.char_length("word"), F.char_length("word") - 1)).alias("length")
    rows = words.select("word", "n", length).select(
        "word", "n", "length", F.inline(_halves(F.lit(0), F.col("length") + 1)))
    cells = stash(_with_cells(rows), "cells")
    while True:
        crowded = cells.where("last - first > 1").groupBy(*CELL).count().where(F.col("count") > cell_words).drop("count")
        crowded = stash(crowded.withColumn("_crowded", F.lit(True)), "crowded")
        if crowded.isEmpty():
            break
        parts = F.when(F.col("_crowded"), _halves(F.col("first"), F.col("last"))).otherwise(F.array(F.struct("first", "last")))
        split = cells.join(small_side(crowded), CELL, "left").select("word", "n", "length", F.inline(parts))
        cells = stash(_with_cells(split), "cells")
    tasks = max(task_count(words), cells.count() // 500_000)
    dealt = cells.repartition(tasks, *CELL).sortWithinPartitions(*CELL)
    return dealt.select("length", "first", "last", "word", "n").mapInArrow(_pairs_in_cells, "word string, near string, near_n long")


def _roots(links: DataFrame) -> DataFrame:
    """(word, root) by following (word, form); every round doubles the steps taken."""
    roots = stash(links.withColumnRenamed("form", "root"), "links")
    while True:
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        step = roots.join(ahead, "root", "left")
        moved = stash(step.select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "roots")
        roots = moved.select("word", "root")
        if moved.where("_moved").isEmpty():
            return roots


def forms(counts: DataFrame, least_letters: int = 5, least_count: int = 3, times: int = 2, cell_words: int = CELL_WORDS) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of the words that are long and frequent enough.

    A word's form is its most frequent near word, the smallest in code-point order among equals, if that is
    ``times`` (2 or more) as frequent as the word; its root is where the forms end, or the word itself.
    ``counts`` has one row per word; null words go.
    """
    if times < 2:
        raise ValueError("forms of equally frequent words would run in circles")
    kept = (F.char_length("word") >= least_letters) & (F.col("n") >= least_count)
    words = stash(counts.where(kept).select("word", "n"), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("near")))
    near = near_pairs(words, cell_words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("_best"))
    is_form = -F.col("_best.m") >= times * F.col("n")
    found = stash(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(is_form, F.col("_best.near")).alias("form"), F.when(is_form, -F.col("_best.m")).alias("form_n")), "forms")
    roots = _roots(found.where(F.col("form").isNotNull()).select("word", "form"))
    return found.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
