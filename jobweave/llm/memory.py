"""Id lists of many words kept as flat arrays: looked up, extended and put together without a loop over words."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs flat[start:start + length], one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, len(flat)) < 1 << 31 else np.int64
    places = np.repeat((starts - (ends - lengths)).astype(kind), lengths)
    places += np.arange(total, dtype=kind)
    return flat[places]


def offsets_of(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)])


def joined_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts one after another, as they lie in the array's buffer; number of bytes of each)."""
    lengths = pc.binary_length(texts).to_numpy().astype(np.int64)
    _, offsets, data = texts.buffers()
    if data is None or not len(texts):
        return np.empty(0, np.uint8), lengths
    edges = np.frombuffer(offsets, np.int64 if texts.type == pa.large_string() else np.int32)[texts.offset:texts.offset + len(texts) + 1]
    return np.frombuffer(data, np.uint8)[edges[0]:edges[-1]], lengths


def cut_at(buffer: np.ndarray, starts: np.ndarray, edges: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(words of all texts, number of words of each): the buffer cut where ``starts`` is true, without copying it.

    ``edges`` says where texts begin and end in the buffer.
    """
    starts[edges] = True
    at = np.flatnonzero(starts)
    large = len(buffer) >= 1 << 31
    offsets = pa.py_buffer(at.astype(np.int64 if large else np.int32))
    words = pa.Array.from_buffers(pa.large_string() if large else pa.string(), max(len(at) - 1, 0), [None, offsets, pa.py_buffer(buffer)])
    return words, np.diff(np.searchsorted(at, edges))


class WordMemory:
    """Ids of words that were met before.

    ``encode`` turns an array of new words into (flat ids, number of ids of each).  At most
    ``most`` words of up to ``longest`` bytes stay; when they would be more, those of the
    latest call stay and the others are encoded again should they return.
    """

    def __init__(self, encode: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], most: int, longest: int = 64):
        self.encode, self.most, self.longest = encode, most, longest
        self.words = pa.array([], pa.string())
        self.flat, self.lengths = np.empty(0, np.int32), np.empty(0, np.int64)

    def ids_of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, number of ids of each) of ``words``, which may repeat."""
        coded = words.dictionary_encode()
        flat, starts, lengths = self._look_up(coded.dictionary)
        at = coded.indices.to_numpy()
        return gather(flat, starts[at], lengths[at]), lengths[at]

    def _look_up(self, different: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(flat ids, start of each word's, number of each word's)."""
        at = pc.fill_null(pc.index_in(different, value_set=self.words), -1).to_numpy()
        missing = at < 0
        new = different.filter(pa.array(missing))
        new_flat, new_lengths = self.encode(new)
        flat, lengths = np.concatenate([self.flat, new_flat.astype(np.int32)]), np.concatenate([self.lengths, new_lengths])
        at = at.astype(np.int64)
        at[missing] = len(self.lengths) + np.arange(len(new_lengths))
        starts = np.cumsum(lengths) - lengths
        found = flat, starts[at], lengths[at]
        self._keep(different, at, new, flat, starts, lengths)
        return found

    def _keep(self, used: pa.Array, at: np.ndarray, new: pa.Array, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
        short = pc.less_equal(pc.binary_length(new), self.longest)
        if len(self.words) + pc.sum(short, min_count=0).as_py() <= self.most:
            stay = np.concatenate([np.ones(len(self.words), bool), short.to_numpy(zero_copy_only=False)])
            self.words = pa.concat_arrays([self.words, new.filter(short)])
            if not stay.all():
                flat, lengths = gather(flat, starts[stay], lengths[stay]), lengths[stay]
        else:
            stay = pc.less_equal(pc.binary_length(used), self.longest).to_numpy(zero_copy_only=False)
            stay &= np.cumsum(stay) <= self.most
            self.words = pa.concat_arrays([used.filter(pa.array(stay))])
            at = at[stay]
            flat, lengths = gather(flat, starts[at], lengths[at]), lengths[at]
        self.flat, self.lengths = flat, lengths
