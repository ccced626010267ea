"""Exact duplicates by Grace hashing: spill files until each bucket fits a table of whole contents."""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobweave.llm.shared import fingerprint, stash

TABLE_BYTES = 48 * 1024 * 1024
FAN_OUT_BITS = 4
NO_ID = -(1 << 63)  # stands for a null id, below all others


class ContentTable:
    """Open addressing with linear probing; an entry is found by its hash and its whole content."""

    def __init__(self, max_bytes: int):
        self.max_bytes, self.used = max_bytes, 0
        self.mask = (1 << 10) - 1
        self.slots = array("q", [-1]) * (self.mask + 1)
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.values: list[list] = []

    def find(self, h: int, content: bytes) -> tuple[int, int]:
        """(entry, slot): the entry is -1 where the content is not there."""
        at = h & self.mask
        while (e := self.slots[at]) >= 0:
            if self.hashes[e] == h and self.contents[e] == content:
                return e, at
            at = (at + 1) & self.mask
        return -1, at

    def has_room(self, content: bytes) -> bool:
        return not self.contents or self.used + len(content) <= self.max_bytes

    def add(self, slot: int, h: int, content: bytes, value: list) -> None:
        self.slots[slot] = len(self.hashes)
        self.hashes.append(h)
        self.contents.append(content)
        self.values.append(value)
        self.used += len(content) + 200
        if 2 * len(self.hashes) > self.mask:
            self._grow()

    def _grow(self) -> None:
        self.mask = 2 * self.mask + 1
        self.slots = array("q", [-1]) * (self.mask + 1)
        for e, h in enumerate(self.hashes):
            at = h & self.mask
            while self.slots[at] >= 0:
                at = (at + 1) & self.mask
            self.slots[at] = e


def grace_groups(records: Iterable[tuple], max_bytes: int = TABLE_BYTES, level: int = 0) -> Iterator[tuple]:
    """Group records (hash, content, id, row, count) of equal content.

    Yields ("member", row, first row of its group) for each record, as it is placed, and
    ("group", first row, hash, content, best id, best row, count) for each group.  A record
    whose content is resident is merged at once.  New contents go to the table while it has
    room, else to one of the spill files chosen by the next bits of the hash; each file is
    then a bucket of its own.  Every level takes at least one content out of its bucket,
    however the hashes fall, so this ends; a group of copies never needs room for more than one.
    """
    table = ContentTable(max_bytes)
    spills: dict[int, object] = {}
    for record in records:
        h, content, best, row, count = record
        e, slot = table.find(h, content)
        if e >= 0:
            value = table.values[e]
            value[1] = max(value[1], (best, row))
            value[2] += count
            yield "member", row, value[0]
        elif table.has_room(content):
            table.add(slot, h, content, [row, (best, row), count])
            yield "member", row, row
        else:
            bucket = (h >> (60 - FAN_OUT_BITS * (level % 12))) & ((1 << FAN_OUT_BITS) - 1)
            if bucket not in spills:
                # Scratch of this task alone, without a name: it goes when it is closed.
                spills[bucket] = tempfile.TemporaryFile()
            pickle.dump(record, spills[bucket], protocol=5)
    for h, content, (first, (best, row), count) in zip(table.hashes, table.contents, table.values):
        yield "group", first, h, content, best, row, count
    del table
    for file in spills.values():
        file.seek(0)
        yield from grace_groups(_records_in(file), max_bytes, level + 1)
        file.close()


def _records_in(file) -> Iterator[tuple]:
    while True:
        try:
            yield pickle.load(file)
        except EOFError:
            return


def _within_split(batches: Iterator[pa.RecordBatch], max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Documents of one input split: a row per document, and a row with the text per distinct text."""
    base = TaskContext.get().partitionId() << 40
    waiting: dict[int, tuple] = {}  # key, fingerprint and digest of rows that are read but not placed

    def records():
        n = 0
        for batch in batches:
            for key, text, h1, h2 in zip(*[c.to_pylist() for c in batch.columns]):
                content = (text or "").encode().lower()  # bytes: A-Z only
                digest = hashlib.sha256(content).digest()
                row = base + n
                n += 1
                waiting[row] = (key, h1, h2, digest)
                yield int.from_bytes(digest[:8], "little"), content, NO_ID if key is None else key, row, 1

    out = _Rows(["doc_id", "_h1", "_h2", "row", "group", "sha", "content", "count", "best_row"],
                [*[pa.int64()] * 5, pa.binary(), pa.binary(), pa.int64(), pa.int64()])
    for found in grace_groups(records(), max_bytes):
        if found[0] == "member":
            _, row, group = found
            key, h1, h2, digest = waiting.pop(row)
            out.add(key, h1, h2, row, group, digest, None, None, None)
        else:
            _, first, _, content, best, best_row, count = found
            out.add(None if best == NO_ID else best, None, None, None, first, hashlib.sha256(content).digest(), content, count, best_row, weight=len(content))
        if out.full():
            yield out.take()
    yield out.take()


def _across_splits(batches: Iterator[pa.RecordBatch], max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Distinct texts of many splits, one hash bucket: (group, keep_id, keep_row, group_size)."""
    rows: list[tuple] = []  # (group, best row) of each record, small beside its content

    def records():
        for batch in batches:
            for group, key, best_row, sha, content, count in zip(*[c.to_pylist() for c in batch.columns]):
                rows.append((group, best_row))
                # Ties of equal ids go to the larger row number; the record's place in ``rows`` names it.
                yield int.from_bytes(sha[8:16], "little"), content, (NO_ID if key is None else key, best_row), len(rows) - 1, count

    members: dict[int, list[int]] = {}
    out = _Rows(["group", "keep_id", "keep_row", "group_size"], [pa.int64()] * 4)
    for found in grace_groups(records(), max_bytes):
        if found[0] == "member":
            members.setdefault(found[2], []).append(found[1])
        else:
            _, first, _, _, (best, best_row), _, count = found
            for at in members.pop(first):
                out.add(rows[at][0], None if best == NO_ID else best, best_row, count)
        if out.full():
            yield out.take()
    yield out.take()


class _Rows:
    """Collects rows into record batches of bounded size."""

    def __init__(self, names: list[str], types: list[pa.DataType], max_rows: int = 20_000, max_weight: int = 8 * 1024 * 1024):
        self.names, self.types, self.max_rows, self.max_weight = names, types, max_rows, max_weight
        self.rows: list[tuple] = []
        self.weight = 0

    def add(self, *row, weight: int = 0) -> None:
        self.rows.append(row)
        self.weight += weight

    def full(self) -> bool:
        return len(self.rows) >= self.max_rows or self.weight >= self.max_weight

    def take(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) or [()] * len(self.names)
        self.rows, self.weight = [], 0
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, self.types)], names=self.names)


def exact_decisions(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(_key, _h1, _h2, times) of every row: 1 where it stays, by :func:`exact_groups`."""
    # Rows that differ in the case of A-Z only are told apart by the fingerprint of the raw text.
    found = exact_groups(docs, key, text)
    return found.select(F.col(key).alias("_key"), "_h1", "_h2", F.col("kept").cast("int").alias("times"))


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", max_bytes: int = TABLE_BYTES) -> DataFrame:
    """(key, _h1, _h2, keep_id, group_size, kept, sha256) of every document.

    Texts are equal when identical after lower-casing A-Z; a null text equals the empty one.  Of
    equal texts the row with the largest key stays, of equal keys one row; a null key is below
    all others.  Repeated rows are members like any others.  Other columns are not looked at.  ``_h1`` and ``_h2`` are the
    fingerprint of the text as it stands.

    First each input split groups its own rows, so a text that a third of all rows hold
    leaves each split once.  Distinct texts then meet by hash; what meets is compared whole.
    Group numbers name a text within its split, so the way back to the rows has no hot key
    beyond one split.
    """
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), *fingerprint(text))
    local = stash(source.mapInArrow(
        lambda batches: _within_split(batches, max_bytes),
        "doc_id long, _h1 long, _h2 long, row long, `group` long, sha binary, content binary, count long, best_row long",
    ), "exact_local")
    texts = local.where("count is not null").select("group", "doc_id", "best_row", "sha", "content", "count")
    classes = texts.repartition("sha").mapInArrow(
        lambda batches: _across_splits(batches, max_bytes), "`group` long, keep_id long, keep_row long, group_size long")
    members = local.where("count is null").select("doc_id", "_h1", "_h2", "row", "group", "sha")
    return members.join(classes, "group").select(
        F.col("doc_id").alias(key), "_h1", "_h2", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("sha")).alias("sha256"),
    )
