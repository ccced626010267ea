"""Token ids as Parquet list columns, written in id order and read back selectively."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from jobweave.llm.chunks import PieceEncoder, slices
from jobweave.llm.memory import offsets_of
from jobweave.llm.shared import small_side

SLICE_BYTES = 8_000_000  # texts encoded at once in a task
MEMORY_WORDS = 200_000  # pieces, and words, whose ids a worker remembers
WORDS_A_CALL = 500
ROWS = "doc_id long, shard int, local_start long, n_tokens long, tokens array<int>"


class LibraryEncoder:
    """The tokenizers library over the different pieces of many texts.

    Pieces of letters are looked up in lower case; only words that were not met lately go to the library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives each task its core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        suffix = self.tokenizer.model.end_of_word_suffix
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for piece, i in self.tokenizer.get_vocab().items():
            self.ends[i] = bool(suffix) and piece.endswith(suffix)
        self.texts = PieceEncoder(self._new_words, self._odd_pieces, MEMORY_WORDS)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(found), np.int32), np.fromiter(map(len, found), np.int64, len(found))

    def _new_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Many words a call: where the ids of one end shows in their pieces."""
        words = words.to_pylist()
        groups = [words[at:at + WORDS_A_CALL] for at in range(0, len(words), WORDS_A_CALL)]
        ids, lengths = self._encode([" ".join(g) for g in groups])
        flat, sizes = [np.empty(0, np.int32)], [np.empty(0, np.int64)]
        for group, part in zip(groups, np.split(ids, np.cumsum(lengths)[:-1])):
            cuts = np.flatnonzero(self.ends[part]) + 1
            part, size = (part, np.diff(cuts, prepend=0)) if len(cuts) == len(group) else self._encode(group)
            flat.append(part)
            sizes.append(size)
        return np.concatenate(flat), np.concatenate(sizes)

    def _odd_pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return self._encode(pieces.to_pylist())

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each)."""
        return self.texts.encode(texts)


@lru_cache(maxsize=4)
def _encoder(path: str) -> LibraryEncoder:
    """One for each Python worker."""
    return LibraryEncoder(path)


def encode_texts(texts: pa.Array, path: str, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, each followed by ``end_id``; number of ids of each)."""
    ids, lengths = _encoder(path).encode(texts)
    return np.insert(ids, np.cumsum(lengths), end_id), lengths + 1


def _encode(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    shard, start = TaskContext.get().partitionId(), 0
    for batch in batches:
        for first, texts in slices(batch.column(1), SLICE_BYTES):
            ids, lengths = encode_texts(texts, path, end_id)
            offsets = offsets_of(lengths)
            tokens = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(first, len(texts)), pa.array(np.full(len(texts), shard), pa.int32()),
                 pa.array(start + offsets[:-1]), pa.array(lengths), tokens],
                names=["doc_id", "shard", "local_start", "n_tokens", "tokens"])
            start += int(offsets[-1])


def write_tokens(
    docs: DataFrame, out: str, tokenizer_path: str, end_id: int, key: str = "doc_id", text: str = "text",
    delta: bool = False, row_group_bytes: int = 32 * 1024 * 1024, page_rows: int = 2_000,
) -> None:
    """Encode every text, append ``end_id``, and write files in rising order of the key.

    Files follow each other by name, and rows within a file, by the key, and rows of one key by a hash
    of their text and the text; a null key comes first.  So no key, however many rows hold it, is one task.  Next to the token list stand doc_id, the file's number (shard), the ids before the row
    in its file (local_start) and n_tokens, delta encoded.  Tokens are dictionary encoded, or with
    ``delta`` delta encoded too.  Row groups hold ``row_group_bytes`` and pages ``page_rows`` rows at
    most; column and offset indexes let a reader take the pages of some documents, or no tokens
    at all.  A null text is empty, one of any length is a single list, and equal rows are all written;
    an empty table gives no rows.  Other columns are left behind, whatever their names.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("_hash", F.xxhash64("text")).repartitionByRange("doc_id", "_hash")
    encoded = rows.sortWithinPartitions("doc_id", "_hash", "text").drop("_hash").mapInArrow(lambda batches: _encode(batches, tokenizer_path, end_id), ROWS)
    options = {
        "compression": "zstd", "parquet.writer.version": "v2", "parquet.block.size": row_group_bytes,
        "parquet.page.row.count.limit": page_rows, "parquet.enable.dictionary": not delta,
        **{f"parquet.enable.dictionary#{c}": False for c in ("doc_id", "shard", "local_start", "n_tokens")},
    }
    encoded.write.options(**options).parquet(out)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ROWS).parquet(path)


def documents_at(files: DataFrame) -> DataFrame:
    """(doc_id, shard, local_start, n_tokens, start) from the files' metadata columns alone.

    ``start`` counts the ids of all documents before.  Only one row per file is ordered in
    one task.
    """
    meta = files.select("doc_id", "shard", "local_start", "n_tokens")
    return meta.join(small_side(shard_starts(files)), "shard").withColumn("start", F.col("_base") + F.col("local_start"))


def shard_starts(files: DataFrame) -> DataFrame:
    """(shard, _base): ids in all files before."""
    ends = files.groupBy("shard").agg(F.sum("n_tokens").alias("_ids"))
    before = F.sum("_ids").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1))
    return ends.select("shard", F.coalesce(before, F.lit(0)).alias("_base"))


def tokens_of(files: DataFrame, first_id: int, last_id: int) -> DataFrame:
    """(doc_id, tokens) of a range of documents; the filter reaches row groups and pages."""
    return files.where(F.col("doc_id").between(first_id, last_id)).select("doc_id", "tokens")


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(batch.schema.get_field_index("tokens"))
        flat, offsets = lists.flatten().to_numpy().astype("<u4"), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
        sums = [zlib.crc32(flat[a:b]) for a, b in zip(offsets, offsets[1:])]
        yield pa.RecordBatch.from_arrays(
            [batch.column(i) for i in range(3)] + [pa.array(np.diff(offsets)), pa.array(sums, pa.int64())],
            names=["doc_id", "shard", "local_start", "n_read", "ids_crc32"])


def read_checked(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files: token lists are read and summed up."""
    sums = files.select("doc_id", "shard", "local_start", "tokens").mapInArrow(
        _checksums, "doc_id long, shard int, local_start long, n_read long, ids_crc32 long")
    rows = sums.join(small_side(shard_starts(files)), "shard")
    return rows.select("doc_id", (F.col("_base") + F.col("local_start")).alias("start"), F.col("n_read").alias("n_tokens"), "ids_crc32")
