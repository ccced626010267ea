"""Word BPE with a lexicon of frequent words: a minimal acyclic transducer, mapped into memory.

The transducer maps a word to its number among the lexicon's sorted words, the sum of the
outputs along its path; ids are kept by number.  States that accept the same endings are one.
Words that are not in it are merged exactly, by rank, as the tokenizer's merge list says.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
import uuid
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobweave.llm.chunks import PieceEncoder, chunks_of, cores_of, pieces_of, slices
from jobweave.llm.memory import gather, joined_bytes, offsets_of
from jobweave.llm.shared import stash, work_path

LEXICON_WORDS = 1 << 16
SLICE_BYTES = 4_000_000  # texts encoded at once in a task
LONG_WORD = 48  # bytes; longer words are merged one by one with a heap
MERGE_STEP = 4  # words whose lengths round up to the same multiple are merged together
MEMORY_WORDS = 200_000  # pieces, and words, whose ids a worker remembers
COUNTED_ROWS = 500_000  # rows of pieces and counts that a task holds before it sums them up


class Merges:
    """The vocabulary and merge list of a word BPE tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max(chain(self.vocab.values(), self.specials.values()))
        self.pieces: list[str] = [""] * size
        for piece, i in chain(self.vocab.items(), self.specials.items()):
            self.pieces[i] = piece
        self._piece_array = pa.array(self.pieces, pa.string())
        end = model["end_of_word_suffix"]
        symbols = byte_symbols()
        self.inner = np.array([self.vocab[s] for s in symbols], np.int64)
        self.final = np.array([self.vocab[s + end] for s in symbols], np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left = np.array([self.vocab[a] for a, _ in pairs], np.int64)
        right = np.array([self.vocab[b] for _, b in pairs], np.int64)
        made = np.array([self.vocab[a + b] for a, b in pairs], np.int64)
        self.base = size + 1  # the number ``size`` stands for no symbol: it fills up shorter words
        keys = left * self.base + right
        order = np.argsort(keys, kind="stable")
        # With a last entry that no pair equals, a search never runs off the end.
        self.keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.ranks = np.append(order, 0)
        self.made = np.append(made[order], 0)
        # Ranks of the pairs of two bytes, inside a word and at its end.
        self.inner_ranks = self.rank(self.inner[:, None], self.inner[None, :]).ravel()
        self.final_ranks = self.rank(self.inner[:, None], self.final[None, :]).ravel()
        self.by_pair = {(int(a), int(b)): (r, int(m)) for r, (a, b, m) in enumerate(zip(left, right, made))}
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.word = regex.compile(split)
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, or a number above all ranks."""
        keys = left * self.base + right
        at = np.searchsorted(self.keys, keys)
        return np.where(self.keys[at] == keys, self.ranks[at], len(self.keys))

    def merge_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, as bytes."""
        ids, lengths = self.merge_flat(pa.array(words, pa.binary()))
        data, at = ids.astype("<i4").tobytes(), (4 * offsets_of(lengths)).tolist()
        return [data[a:b] for a, b in zip(at, at[1:])]

    def merge_flat(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, number of ids of each): the lowest rank first, of equal ranks the leftmost, until no pair merges."""
        buffer, sizes = joined_bytes(words)
        first = np.cumsum(sizes) - sizes
        flat, starts, lengths, total = [np.empty(0, np.int32)], np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), 0
        for i in np.flatnonzero(sizes > LONG_WORD).tolist():
            flat.append(np.array(self._merge_long(buffer[first[i]:first[i] + sizes[i]].tobytes()), np.int32))
            starts[i], lengths[i] = total, len(flat[-1])
            total += len(flat[-1])
        steps = np.where((sizes > 0) & (sizes <= LONG_WORD), -(-sizes // MERGE_STEP), 0)
        for step in np.unique(steps[steps > 0]).tolist():
            at = np.flatnonzero(steps == step)
            for names, ids in self._merge_block(buffer, first[at], sizes[at]):
                real = ids < self.base - 1
                flat.append(ids[real].astype(np.int32))
                lengths[at[names]] = size = real.sum(axis=1)
                starts[at[names]] = total + np.cumsum(size) - size
                total += len(flat[-1])
        return gather(np.concatenate(flat), starts, lengths), lengths

    def _merge_block(self, buffer: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(numbers of words that are done, their ids) for words of up to one length, which lie in the buffer from ``first`` on.

        Each step merges one pair in every word that has one; shorter words are filled up at their ends.
        """
        names, none = np.arange(len(first)), len(self.keys)
        places = np.arange(sizes.max())
        rows = buffer[np.minimum(first[:, None] + places, len(buffer) - 1)].astype(np.int64)
        ids = np.where(places < sizes[:, None], self.inner[rows], self.base - 1)
        ids[names, sizes - 1] = self.final[rows[names, sizes - 1]]
        pairs = rows[:, :-1] << 8 | rows[:, 1:]
        ranks = np.where(places[1:] < sizes[:, None] - 1, self.inner_ranks[pairs], none)
        more = np.flatnonzero(sizes > 1)
        ranks[more, sizes[more] - 2] = self.final_ranks[pairs[more, sizes[more] - 2]]
        while len(ids):
            done = ranks.min(axis=1) == none if ranks.shape[1] else np.ones(len(ids), bool)
            if done.any():
                yield names[done], ids[done]
                names, ids, ranks = names[~done], ids[~done], ranks[~done]
            if not len(ids):
                return
            n, width = ids.shape
            every, best = np.arange(n), ranks.argmin(axis=1)
            keys = ids[every, best] * self.base + ids[every, best + 1]
            ids[every, best] = self.made[np.searchsorted(self.keys, keys)]
            keep = np.ones((n, width), bool)
            keep[every, best + 1] = False
            ids = ids[keep].reshape(n, width - 1)
            ranks = ranks[keep[:, 1:]].reshape(n, width - 2)
            for at, inside in ((best - 1, best > 0), (best, best < width - 2)):
                r, c = every[inside], at[inside]
                ranks[r, c] = self.rank(ids[r, c], ids[r, c + 1])

    def _merge_long(self, word: bytes) -> list[int]:
        ids = self.inner[np.frombuffer(word, np.uint8)].tolist()
        ids[-1] = int(self.final[word[-1]])
        before, after = list(range(-1, len(ids) - 1)), list(range(1, len(ids) + 1))
        heap: list[tuple] = []

        def offer(a: int) -> None:
            if 0 <= a and after[a] < len(ids) and (found := self.by_pair.get((ids[a], ids[after[a]]))):
                heapq.heappush(heap, (found[0], a, ids[a], ids[after[a]], found[1]))

        for a in range(len(ids) - 1):
            offer(a)
        while heap:
            _, a, left, right, made = heapq.heappop(heap)
            b = after[a] if ids[a] == left else len(ids)
            if b >= len(ids) or ids[b] != right:
                continue  # one of the two has changed since
            ids[a], ids[b], after[a] = made, -1, after[b]
            if after[b] < len(ids):
                before[after[b]] = a
            offer(before[a])
            offer(a)
        return [i for i in ids if i >= 0]

    def words(self, chunk: str) -> list[bytes]:
        """The words of a chunk without special tokens: NFC, lower case, cut by the pattern."""
        text = unicodedata.normalize("NFC", chunk)
        # One character at a time: str.lower() alone turns a sigma at the end into another letter.
        text = text.lower() if "Σ" not in text else "".join(map(str.lower, text))
        return [m.encode() for m in self.word.findall(text)]

    def parts(self, chunk: str) -> list[int | bytes]:
        """Ids of special tokens and words, in order."""
        if self.special is None or "<" not in chunk:
            return self.words(chunk)
        out: list[int | bytes] = []
        at = 0
        for m in self.special.finditer(chunk):
            out += self.words(chunk[at:m.start()])
            out.append(self.specials[m.group()])
            at = m.end()
        return out + self.words(chunk[at:])

    def pieces_in(self, core: str) -> list[int | bytes]:
        """``parts`` of a text that may hold white space."""
        return [p for chunk in chunks_of(core) for p in self.parts(chunk)]

    def decode(self, ids) -> str:
        """Pieces joined by a space, as for a tokenizer file without a decoder."""
        return " ".join(map(self.pieces.__getitem__, ids))

    def decode_lists(self, offsets: np.ndarray, ids: np.ndarray) -> pa.Array:
        """``decode`` of many texts at once; ``offsets`` says where each one's ids begin and end."""
        pieces = self._piece_array.take(pa.array(ids))
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pieces), " ")


def byte_symbols() -> list[str]:
    """The character that stands for each byte: itself where it prints, else one from 256 on."""
    prints = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(rest)) for b in range(256)]


class Lexicon:
    """The transducer, as arrays that lie one after another in a file.

    An arc is found by (state << 8 | byte) in a sorted array.  ``target`` is its next state and
    ``output`` how many words of the lexicon come before those that pass through it, among those
    through its state.
    """

    FIELDS = ("arcs", "target", "output", "final", "offsets", "ids")

    def __init__(self, arrays: dict[str, np.ndarray], start: int, longest: int):
        self.__dict__.update(arrays)
        self.start, self.longest = start, longest

    @classmethod
    def compile(cls, words: list[bytes], ids: list[bytes]) -> Lexicon:
        """``words`` sorted and different; ``ids`` beside them.

        States are finished from the end of the previous word; a finished state that has the same
        finality and arcs as an earlier one is replaced by it, which leaves no two equal states.
        """
        register: dict[tuple, int] = {}
        states: list[tuple[bool, tuple]] = []
        counts: list[int] = []

        def finish(node: list) -> int:
            shape = (node[0], tuple(node[1]))
            if shape not in register:
                register[shape] = len(states)
                states.append(shape)
                counts.append(node[0] + sum(counts[t] for _, t in node[1]))
            return register[shape]

        path: list[list] = [[False, []]]
        last = b""
        for word in words:
            same = 0
            while same < len(last) and same < len(word) and last[same] == word[same]:
                same += 1
            for depth in range(len(last), same, -1):
                path[depth - 1][1].append((last[depth - 1], finish(path.pop())))
            path += [[False, []] for _ in word[same:]]
            path[-1][0] = True
            last = word
        for depth in range(len(last), 0, -1):
            path[depth - 1][1].append((last[depth - 1], finish(path.pop())))
        start = finish(path[0])

        arcs, target, output = [], [], []
        for s, (final, out) in enumerate(states):
            passed = int(final)
            for byte, t in out:
                arcs.append(s << 8 | byte)
                target.append(t)
                output.append(passed)
                passed += counts[t]
        lengths = np.fromiter((len(i) // 4 for i in ids), np.uint32, len(ids))
        return cls({
            "arcs": np.array([*arcs, 0xFFFFFFFFFFFFFFFF], "<u8"), "target": np.array([*target, 0], "<u4"), "output": np.array([*output, 0], "<u4"),
            "final": np.array([f for f, _ in states], "<u4"), "offsets": np.append(np.uint32(0), np.cumsum(lengths)).astype("<u4"),
            "ids": np.frombuffer(b"".join(ids), "<u4"),
        }, start, max(map(len, words), default=0))

    def to_bytes(self) -> bytes:
        arrays = [getattr(self, f) for f in self.FIELDS]
        # Eight numbers come first, so that the arcs, which take two each, lie where 64-bit numbers may.
        head = np.array([self.start, self.longest, *map(len, arrays)], "<u4")
        return head.tobytes() + b"".join(a.tobytes() for a in arrays)

    @classmethod
    def open(cls, path: str) -> Lexicon:
        """Map the file; workers on one machine share its pages."""
        data = np.memmap(path, "<u4", "r")
        at, arrays = 2 + len(cls.FIELDS), {}
        for name, n in zip(cls.FIELDS, data[2:at].tolist()):
            width = 2 if name == "arcs" else 1
            arrays[name] = data[at:at + width * n].view("<u8" if width == 2 else "<u4")
            at += width * n
        return cls(arrays, int(data[0]), int(data[1]))

    def numbers(self, words: pa.Array | list[bytes]) -> np.ndarray:
        """The number of each word, or -1.  All words take one step at a time together."""
        found = np.full(len(words), -1, np.int64)
        flat, lengths = joined_bytes(words if isinstance(words, pa.Array) else pa.array(words, pa.binary()))
        starts = np.cumsum(lengths) - lengths
        live = np.flatnonzero(lengths <= self.longest)
        state = np.full(len(words), self.start, np.int64)
        total = np.zeros(len(words), np.int64)
        for step in range(self.longest + 1):
            over = lengths[live] == step
            ended = live[over]
            done = ended[self.final[state[ended]] == 1]
            found[done] = total[done]
            live = live[~over]
            if not len(live):
                break
            key = (state[live] << 8 | flat[starts[live] + step]).astype(np.uint64)
            at = np.searchsorted(self.arcs, key)
            hit = self.arcs[at] == key
            live, at = live[hit], at[hit]
            state[live] = self.target[at]
            total[live] += self.output[at]
        return found

    def lengths(self) -> np.ndarray:
        """Number of ids of each word."""
        return np.diff(self.offsets.astype(np.int64))


@lru_cache(maxsize=2)
def merges_of(path: str) -> Merges:
    return Merges(path)


@lru_cache(maxsize=2)
def _encoder(tokenizer_path: str, lexicon_name: str) -> Encoder:
    return Encoder(merges_of(tokenizer_path), Lexicon.open(SparkFiles.get(lexicon_name)))


class Encoder:
    """Encodes texts: words by the lexicon, others by merging."""

    def __init__(self, merges: Merges, lexicon: Lexicon):
        self.merges, self.lexicon = merges, lexicon
        self.texts = PieceEncoder(self.word_ids, self.odd_ids, MEMORY_WORDS)

    def word_ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, number of ids of each)."""
        numbers = self.lexicon.numbers(words)
        unseen = numbers < 0
        merged, sizes = self.merges.merge_flat(words.filter(pa.array(unseen)))
        known, at = self.lexicon.lengths(), numbers[~unseen]
        lengths, starts = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        lengths[unseen], lengths[~unseen] = sizes, known[at]
        starts[unseen], starts[~unseen] = len(self.lexicon.ids) + np.cumsum(sizes) - sizes, self.lexicon.offsets[at]
        return gather(np.concatenate([self.lexicon.ids.astype(np.int32), merged]), starts, lengths), lengths

    def odd_ids(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, number of ids of each): their special tokens and words are found one piece at a time."""
        parts = [self.merges.pieces_in(p) for p in pieces.to_pylist()]
        words = list({p for ps in parts for p in ps if isinstance(p, bytes)})
        flat, sizes = self.word_ids(pa.array(words, pa.binary()))
        data, at = flat.astype("<i4").tobytes(), (4 * offsets_of(sizes)).tolist()
        ids = {w: data[a:b] for w, a, b in zip(words, at, at[1:])}
        found = [b"".join(ids[p] if isinstance(p, bytes) else p.to_bytes(4, "little") for p in ps) for ps in parts]
        return np.frombuffer(b"".join(found), "<i4"), np.fromiter((len(f) // 4 for f in found), np.int64, len(found))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each)."""
        return self.texts.encode(texts)


def _summed(rows: list[pa.Table], key: str) -> pa.Table:
    """(key, n) with different keys.  In this thread: Spark gives each task its core."""
    return pa.concat_tables(rows).group_by(key, use_threads=False).aggregate([("n", "sum")]).select([key, "n_sum"]).rename_columns([key, "n"])


def _words_of(pieces: pa.Table, merges: Merges) -> pa.Table:
    """(word, n) of different pieces and their numbers.  A piece is cut into words once for all its occurrences."""
    pieces = pieces.combine_chunks()
    core, plain = cores_of(pieces["piece"])
    n, odd, plain = pieces["n"], pa.array(~plain), pa.array(plain)
    words, times = [], []
    for piece, k in zip(core.filter(odd).to_pylist(), n.filter(odd).to_pylist()):
        found = [p for p in merges.pieces_in(piece) if isinstance(p, bytes)]
        words += found
        times += [k] * len(found)
    letters = pa.table({"word": pc.utf8_lower(core.filter(plain)).cast(pa.binary()), "n": n.filter(plain)})
    return _summed([letters, pa.table({"word": pa.array(words, pa.binary()), "n": pa.array(times, pa.int64())})], "word")


def _count_words(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    merges = merges_of(path)
    held: list[pa.Table] = []
    for batch in batches:
        for _, texts in slices(batch.column(0), SLICE_BYTES):
            counts = pieces_of(texts)[0].value_counts()
            held.append(pa.table({"piece": pc.ascii_trim_whitespace(counts.field("values")), "n": counts.field("counts")}))
            if sum(t.num_rows for t in held) > COUNTED_ROWS:
                held = [_summed(held, "piece")]
                if held[0].num_rows > COUNTED_ROWS // 2:
                    yield from _words_of(held.pop(), merges).to_batches()
    if held:
        yield from _words_of(_summed(held, "piece"), merges).to_batches()


def frequent_words(docs: DataFrame, tokenizer_path: str, text: str = "text", most: int = LEXICON_WORDS) -> list[bytes]:
    """The most frequent words of all texts, by count over the whole corpus; none longer than LONG_WORD bytes.

    All words that occur as often as the last one are in, as long as there are ``most`` at most.
    """
    counts = docs.select(F.col(text).alias("text")).mapInArrow(lambda b: _count_words(b, tokenizer_path), "word binary, n long")
    counts = counts.where(F.octet_length("word") <= LONG_WORD).groupBy("word").agg(F.sum("n").alias("n"))
    counts = stash(counts, "word_counts")
    # The smallest count that no more than ``most`` words reach; one row per count is ordered here.
    sizes = counts.groupBy("n").agg(F.count(F.lit(1)).alias("_words"))
    reach = sizes.select("n", F.sum("_words").over(W.orderBy(F.desc("n"))).alias("_reach"))
    least = reach.where(F.col("_reach") <= most).agg(F.min("n")).first()[0]
    if least is None:
        return []
    return [bytes(r.word) for r in counts.where(F.col("n") >= least).select("word").collect()]


def build_lexicon(docs: DataFrame, tokenizer_path: str, text: str = "text", most: int = LEXICON_WORDS) -> str:
    """Compile the frequent words and hand the file to all executors; returns its name there.

    The list is bounded by ``most``, whatever the corpus holds; a word beyond it costs a
    merge, never a wrong id.  The file lies in the shared folder, from which Spark copies it to
    every executor, also to those that start later.
    """
    words = sorted(frequent_words(docs, tokenizer_path, text, most))
    blob = Lexicon.compile(words, merges_of(tokenizer_path).merge_words(words)).to_bytes()
    name = f"lexicon-{uuid.uuid4().hex[:24]}.bin"
    return _share(docs.sparkSession, name, blob)


def _share(spark: SparkSession, name: str, blob: bytes) -> str:
    jvm, sc = spark.sparkContext._jvm, spark.sparkContext
    path = jvm.org.apache.hadoop.fs.Path(work_path(spark, name))
    out = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path, True)
    try:
        out.write(bytearray(blob))
    finally:
        out.close()
    sc.addFile(path.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(path).toString())
    return name


def _encode_batches(batches: Iterator[pa.RecordBatch], tokenizer_path: str, lexicon: str) -> Iterator[pa.RecordBatch]:
    encoder = _encoder(tokenizer_path, lexicon)
    for batch in batches:
        for first, texts in slices(batch.column(1), SLICE_BYTES):
            ids, lengths = encoder.encode(texts)
            offsets = offsets_of(lengths)
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
            decoded = encoder.merges.decode_lists(offsets, ids)
            beside = [c.slice(first, len(texts)) for i, c in enumerate(batch.columns) if i != 1]
            yield pa.RecordBatch.from_arrays([beside[0], lists, decoded, *beside[1:]], names=["doc_id", "ids", "decoded", *batch.schema.names[2:]])


def encode_decode(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", most: int = LEXICON_WORDS, beside: Sequence[str] = ()) -> DataFrame:
    """(key, ids array<int>, decoded) of every document; the decoded text is made from the ids.

    A null text is empty and has no ids.  Repeated rows give repeated results; of the other columns
    those named in ``beside`` come along.  An empty table gives an empty result.
    """
    lexicon = build_lexicon(docs, tokenizer_path, text, most)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), *beside)
    schema = T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType()),
        *[rows.schema[c] for c in beside]])
    out = rows.mapInArrow(lambda b: _encode_batches(b, tokenizer_path, lexicon), schema)
    return out.withColumnRenamed("doc_id", key)
