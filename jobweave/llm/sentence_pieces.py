"""SentencePiece BPE with byte fallback: words merged together in vectorised rounds.

The symbols of many words lie in one array.  In a round every word merges its pair of lowest
rank wherever it occurs, leftmost first where occurrences overlap; then the array is closed up.
Words without a pair leave, and rounds go on until none is left.
"""

from __future__ import annotations

import codecs
import heapq
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobweave.llm.chunks import slices
from jobweave.llm.memory import WordMemory, cut_at, gather, joined_bytes, offsets_of

SLICE_BYTES = 8_000_000  # texts encoded at once in a task
MEMORY_WORDS = 200_000  # words whose ids a worker remembers
LONG_RUN = 2_048  # symbols; a run without any place to cut is merged one pair at a time beyond this
SPACE = "▁"  # stands for a space in pieces
CODES = 0x110000
# Kinds of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6


class PieceModel:
    """Pieces, pair ranks and places to cut of a model file.

    A symbol is a piece's id, or ``base`` plus a code point that is no piece.  Any two neighbours
    whose texts together are a piece can merge; the higher the piece's score the lower the rank.
    """

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        trained, rules = model.trainer_spec, model.normalizer_spec
        kinds = [p.type for p in model.pieces]
        if trained.model_type != trained.BPE or not trained.byte_fallback or not set(kinds) <= {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("a BPE model with byte fallback and without pieces defined by users is needed")
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces or trained.treat_whitespace_as_suffix:
            raise ValueError("a model that leaves texts as they are is needed")
        self.prefix = rules.add_dummy_prefix
        self.end = trained.eos_id
        pieces = [p.piece for p in model.pieces]
        ids = {p: i for i, (p, k) in enumerate(zip(pieces, kinds)) if k == NORMAL}
        self.base = len(pieces)
        self.bytes = np.full(256, -1, np.int64)
        for i, (p, k) in enumerate(zip(pieces, kinds)):
            if k == BYTE:
                self.bytes[int(p[1:-1], 16)] = i

        symbol = np.arange(CODES, dtype=np.int64) + self.base
        for p, i in ids.items():
            if len(p) == 1:
                symbol[ord(p)] = i
        symbol[ord(" ")] = symbol[ord(SPACE)]
        self.symbol = symbol
        scores = {-model.pieces[i].score for i in ids.values()}
        rank_of = {s: r for r, s in enumerate(sorted(scores))}
        self.none = len(rank_of)
        self.span = self.base + CODES

        def part(p: str) -> int | None:
            return int(symbol[ord(p)]) if len(p) == 1 else ids.get(p)

        pairs, beside = [], set()
        for p, i in ids.items():
            beside.update(zip(p, p[1:]))
            for cut in range(1, len(p)):
                a, b = part(p[:cut]), part(p[cut:])
                if a is not None and b is not None:
                    pairs.append((a * self.span + b, rank_of[-model.pieces[i].score], i))
        keys, ranks, made = np.array(sorted(pairs), np.int64).reshape(-1, 3).T
        # With a last entry that no pair equals, a search never runs off the end.
        self.keys = np.append(keys, np.iinfo(np.int64).max)
        self.ranks, self.made = np.append(ranks, self.none), np.append(made, 0)
        # Neighbours that no piece holds side by side are never merged: texts can be cut there.
        codes = {SPACE: ord(" ")}
        self.beside = np.sort(np.array([codes.get(a, ord(a)) * CODES + codes.get(b, ord(b)) for a, b in beside] + [-1], np.int64))
        joined = {c for pair in beside for c in pair}
        # ASCII characters that are never part of a longer piece; a space only ever begins one.
        self.alone = np.array([c for c in range(128) if chr(c) not in joined and chr(c) != " "], np.uint8)
        self.space_begins = all(SPACE not in p.lstrip(SPACE) for p in ids)

        texts = [self._bytes_of(p, k) for p, k in zip(pieces, kinds)]
        self.text_lengths = np.array([len(t) for t in texts], np.int64)
        self.text_starts = np.cumsum(self.text_lengths) - self.text_lengths
        self.text_bytes = np.frombuffer(b"".join(texts), np.uint8)
        self.control = np.array([k == CONTROL for k in kinds])
        self.spaced = np.array([k == NORMAL and p.startswith(SPACE) for p, k in zip(pieces, kinds)])

    @staticmethod
    def _bytes_of(piece: str, kind: int) -> bytes:
        if kind == BYTE:
            return bytes([int(piece[1:-1], 16)])
        if kind == CONTROL:
            return b""
        return " ⁇ ".encode() if kind == UNKNOWN else piece.replace(SPACE, " ").encode()

    def pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Place of each pair in the table, the last one for those that are not in it."""
        keys = left * self.span + right
        at = np.searchsorted(self.keys, keys)
        return np.where(self.keys[at] == keys, at, len(self.keys) - 1)

    def merge(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbols left, number of each word's) after all merges of words of the given lengths.

        A word merges all its pairs of lowest rank at once only up to the first merge that makes a
        pair of the same or a lower rank with its neighbours: that pair would be next.
        """
        none = len(self.keys) - 1
        word = np.repeat(np.arange(len(lengths)), lengths)
        sym = symbols.astype(np.int64)
        pair = np.full(len(sym), none)
        if len(sym) > 1:
            inside = np.flatnonzero(word[1:] == word[:-1])
            pair[inside] = self.pairs(sym[inside], sym[inside + 1])
        done_words, done_symbols = [word[:0]], [sym[:0]]
        while len(sym):
            n = len(sym)
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            rank = self.ranks[pair]
            best = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, n)))
            live = best < self.none
            if not live.all():
                done_words.append(word[~live])
                done_symbols.append(sym[~live])
                sym, word, pair, rank, best = sym[live], word[live], pair[live], rank[live], best[live]
                n = len(sym)
                if not n:
                    break
            at = np.flatnonzero(rank == best)
            # Of pairs that follow each other and so overlap, every second one merges.
            begins = np.concatenate([[True], np.diff(at) > 1])
            order = np.arange(len(at))
            at = at[(order - np.maximum.accumulate(np.where(begins, order, 0))) % 2 == 0]
            at = self._undisturbed(at, sym, word, pair, best)
            sym[at] = self.made[pair[at]]
            keep = np.ones(n, bool)
            keep[at + 1] = False
            moved = np.cumsum(keep)[at] - 1
            sym, word, pair = sym[keep], word[keep], pair[keep]
            for left in (moved, moved[moved > 0] - 1):
                within = (left + 1 < len(sym)) & (word[left] == word[np.minimum(left + 1, len(sym) - 1)])
                pair[left] = none
                left = left[within]
                pair[left] = self.pairs(sym[left], sym[left + 1])
        words, found = np.concatenate(done_words), np.concatenate(done_symbols)
        return found[np.argsort(words, kind="stable")], np.bincount(words, minlength=len(lengths))

    def _undisturbed(self, at: np.ndarray, sym: np.ndarray, word: np.ndarray, pair: np.ndarray, best: np.ndarray) -> np.ndarray:
        """Of the merges at ``at``, for each word those up to the first that makes a pair to be merged before the next."""
        n, made = len(sym), self.made[pair[at]]
        before = np.maximum(at - 1, 0)
        left = sym[before]
        touches = np.concatenate([[False], at[1:] - at[:-1] == 2])
        left = np.where(touches, np.concatenate([[0], made[:-1]]), left)
        after = np.minimum(at + 2, n - 1)
        rank_left = np.where((at > 0) & (word[before] == word[at]), self.ranks[self.pairs(left, made)], self.none)
        rank_right = np.where((at + 2 < n) & (word[after] == word[at]), self.ranks[self.pairs(made, sym[after])], self.none)
        disturbed = np.minimum(rank_left, rank_right) <= best[at]
        if not disturbed.any():
            return at
        # Merges of one word after the first disturbed one wait.
        earlier = np.cumsum(disturbed) - disturbed
        first = np.concatenate([[True], word[at[1:]] != word[at[:-1]]])
        at_first = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
        return at[earlier == earlier[at_first]]

    def merge_long(self, symbols: np.ndarray) -> np.ndarray:
        """The same for one very long word, one merge after another from a heap."""
        ids = symbols.tolist()
        before, after = list(range(-1, len(ids) - 1)), list(range(1, len(ids) + 1))
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(places: Sequence[int]) -> None:
            places = [a for a in places if a >= 0 and after[a] < len(ids)]
            found = self.pairs(np.array([ids[a] for a in places], np.int64), np.array([ids[after[a]] for a in places], np.int64))
            for a, p in zip(places, found.tolist()):
                if self.ranks[p] < self.none:
                    heapq.heappush(heap, (int(self.ranks[p]), a, ids[a], ids[after[a]], int(self.made[p])))

        offer(range(len(ids) - 1))
        while heap:
            _, a, left, right, made = heapq.heappop(heap)
            b = after[a] if ids[a] == left else len(ids)
            if b >= len(ids) or ids[b] != right:
                continue  # one of the two has changed since
            ids[a], ids[b], after[a] = made, -1, after[b]
            if after[b] < len(ids):
                before[after[b]] = a
            offer((before[a], a))
        return np.array([i for i in ids if i >= 0], np.int64)

    def encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, number of ids of each word), without an end id."""
        if not len(words):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        strings = words.to_pylist()
        sizes = np.fromiter(map(len, strings), np.int64, len(strings))
        codes = np.frombuffer("".join(strings).encode("utf-32-le"), np.uint32).astype(np.int64)
        sym = self.symbol[codes]
        # Cut into runs where no piece spans two neighbours.
        starts = np.zeros(len(codes) + 1, bool)
        starts[offsets_of(sizes)] = True
        plain = np.where(codes == ord(SPACE), ord(" "), codes)
        keys = plain[:-1] * CODES + plain[1:]
        at = np.minimum(np.searchsorted(self.beside, keys), len(self.beside) - 1)
        starts[1:-1] |= self.beside[at] != keys
        edges = np.flatnonzero(starts)
        lengths = np.diff(edges)
        long = np.flatnonzero(lengths > LONG_RUN)
        short = np.ones(len(lengths), bool)
        short[long] = False
        merged, left = self.merge(sym[np.repeat(short, lengths)], lengths[short])
        counts = np.zeros(len(lengths), np.int64)
        counts[short] = left
        if len(long):
            parts = {r: self.merge_long(sym[edges[r]:edges[r + 1]]) for r in long.tolist()}
            counts[long] = [len(parts[r]) for r in long.tolist()]
            out, to = np.empty(int(counts.sum()), np.int64), offsets_of(counts)
            out[np.repeat(short, counts)] = merged
            for r, part in parts.items():
                out[to[r]:to[r + 1]] = part
            merged = out
        # Symbols of each word: runs do not cross words.
        owner = np.searchsorted(offsets_of(sizes)[1:], edges[:-1], side="right")
        per_word = np.bincount(owner, weights=counts, minlength=len(sizes)).astype(np.int64)
        return self._fall_back(merged, per_word)

    def _fall_back(self, sym: np.ndarray, per_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols without a piece become the bytes of their character."""
        odd = np.flatnonzero(sym >= self.base)
        if not len(odd):
            return sym, per_word
        codes, which = np.unique(sym[odd] - self.base, return_inverse=True)
        spelt = [np.frombuffer(chr(c).encode("utf-8", "surrogatepass"), np.uint8) for c in codes.tolist()]
        table, lengths = self.bytes[np.concatenate(spelt)], np.array([len(b) for b in spelt], np.int64)
        flat = np.concatenate([sym, table])
        starts, sizes = np.arange(len(sym)), np.ones(len(sym), np.int64)
        starts[odd], sizes[odd] = len(sym) + (np.cumsum(lengths) - lengths)[which], lengths[which]
        owner = np.repeat(np.arange(len(per_word)), per_word)
        return gather(flat, starts, sizes), np.bincount(owner, weights=sizes, minlength=len(per_word)).astype(np.int64)

    def cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """(words of all texts, number of words of each): no piece spans two of them.

        A word takes the spaces before it along.  The words share one buffer with the texts.
        """
        data, lengths = joined_bytes(texts)
        edges = offsets_of(lengths + (lengths > 0) * int(self.prefix))
        buffer = np.full(int(edges[-1]), ord(" "), np.uint8)
        body = np.ones(len(buffer), bool)
        if self.prefix:
            body[edges[:-1][lengths > 0]] = False
        buffer[body] = data
        starts = np.zeros(len(buffer) + 1, bool)
        if self.space_begins and len(buffer):
            blank = buffer == ord(" ")
            starts[1:-1] |= blank[1:] & ~blank[:-1] & (buffer[:-1] != 0x81)  # the last byte of a written-out space sign
            lonely = np.isin(buffer, self.alone)
            starts[:-1] |= lonely
            starts[1:] |= lonely
        return cut_at(buffer, starts, edges)

    def decode_flat(self, ids: np.ndarray, lengths: np.ndarray) -> list[str]:
        """The text of each list of ids: pieces joined, without the space put before the first."""
        sizes = self.text_lengths[ids]
        data = gather(self.text_bytes, self.text_starts[ids], sizes)
        bounds = offsets_of(sizes)[offsets_of(lengths)]
        skip = np.zeros(len(lengths), np.int64)
        if self.prefix and len(ids):
            shown = np.flatnonzero(~self.control[ids])
            owner = np.repeat(np.arange(len(lengths)), lengths)[shown]
            which, first = np.unique(owner, return_index=True)
            skip[which] = self.spaced[ids[shown[first]]]
        whole, out = data.tobytes(), []
        inner, ends = self._inner_controls(ids, lengths), offsets_of(sizes)
        for k, (a, b, s) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), skip.tolist())):
            # A control id ends a run of bytes.
            cuts = [a + s, *(np.maximum(ends[inner[k]], a + s).tolist() if k in inner else ()), b]
            out.append("".join(whole[x:y].decode("utf-8", "one-by-one") for x, y in zip(cuts, cuts[1:])))
        return out

    def _inner_controls(self, ids: np.ndarray, lengths: np.ndarray) -> dict[int, np.ndarray]:
        """Places of control ids by list, where they are neither the first nor the last id."""
        edge = np.zeros(len(ids) + 1, bool)
        edges = offsets_of(lengths)
        edge[edges] = True
        edge[edges[1:] - 1] = True
        at = np.flatnonzero(self.control[ids] & ~edge[:-1])
        owner = np.searchsorted(edges, at, side="right") - 1
        return {k: at[owner == k] for k in np.unique(owner).tolist()}


def _one_by_one(error: UnicodeError) -> tuple[str, int]:
    """Each byte that is no part of a character becomes a sign of its own."""
    return "�", error.start + 1


codecs.register_error("one-by-one", _one_by_one)


class PieceEncoder:
    """Texts to ids; remembers the ids of words."""

    def __init__(self, path: str):
        self.model = PieceModel(path)
        self.memory = WordMemory(self.model.encode_words, MEMORY_WORDS)

    def encode(self, texts: pa.Array, end: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each), with ``end`` an end id after each text."""
        words, counts = self.model.cut(texts)
        ids, lengths = self.memory.ids_of(words)
        each = np.diff(offsets_of(lengths)[offsets_of(counts)])
        return (np.insert(ids, np.cumsum(each), self.model.end), each + 1) if end else (ids, each)


@lru_cache(maxsize=2)
def encoder_of(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def _encode_batches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    encoder = encoder_of(path)
    for batch in batches:
        for first, texts in slices(batch.column(1), SLICE_BYTES):
            ids, lengths = encoder.encode(texts)
            lists = pa.ListArray.from_arrays(pa.array(offsets_of(lengths), pa.int32()), pa.array(ids, pa.int32()))
            decoded = pa.array(encoder.model.decode_flat(ids, lengths), pa.string())
            beside = [c.slice(first, len(texts)) for i, c in enumerate(batch.columns) if i != 1]
            yield pa.RecordBatch.from_arrays([beside[0], lists, decoded, *beside[1:]], names=["_key", "_ids", "_decoded", *batch.schema.names[2:]])


def encode_decode(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text", beside: Sequence[str] = ()) -> DataFrame:
    """(key, ids array<int>, decoded) of every document, an end id after each; the text is decoded from the ids.

    A null text is empty and has the end id alone.  Texts of any length are encoded whole: a task
    holds one slice of texts, or one longer text, at a time.  Equal texts and repeated rows give
    equal results; an empty table gives an empty one.  Other columns named in ``beside`` come
    along whatever their names are; a clash with ``ids`` or ``decoded`` is left to the caller.
    """
    rows = docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text"), *[F.col(f"`{c}`").alias(f"_b{i}") for i, c in enumerate(beside)])
    schema = T.StructType([
        rows.schema["_key"], T.StructField("_ids", T.ArrayType(T.IntegerType())), T.StructField("_decoded", T.StringType()), *rows.schema.fields[2:]])
    out = rows.mapInArrow(lambda b: _encode_batches(b, model_path), schema)
    return out.toDF(key, "ids", "decoded", *beside)
