"""Texts encoded piece by piece: no token of the word tokenizers crosses white space."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from jobweave.llm.memory import WordMemory, cut_at, gather, joined_bytes, offsets_of

# White space as the tokenizer's own patterns see it (Unicode White_Space).
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_CUT = re.compile(f"[{SPACES}]+")
# str.split() also cuts at these four.
_ONLY_PYTHON = re.compile("[\x1c-\x1f]")
# Letters that are one character in lower case and composed already.
PLAIN = "^[A-Za-zÀ-ÖØ-öø-ÿ]+$"
# ASCII characters that no token takes together with a letter before them.
MARKS = ".,;:!?#$%&*"
_SPACE, _MARK, _LETTER, _TAIL = 1, 2, 3, 4
_KINDS = np.zeros(256, np.uint8)
_KINDS[[9, 10, 11, 12, 13, 32]] = _SPACE
_KINDS[[ord(c) for c in MARKS]] = _MARK
_KINDS[[*range(65, 91), *range(97, 123)]] = _LETTER
# Second bytes, after 0xC3, of the letters from À to ÿ.
_KINDS[[c.encode()[1] for c in map(chr, range(0xC0, 0x100)) if c.isalpha()]] = _TAIL


def chunks_of(text: str) -> list[str]:
    if _ONLY_PYTHON.search(text) is None:
        return text.split()
    return [c for c in _CUT.split(text) if c]


def slices(texts: pa.Array, most: int) -> Iterator[tuple[int, pa.Array]]:
    """(position of the first, texts) for runs of about ``most`` bytes; null counts as empty."""
    texts = texts.fill_null("")
    run = np.cumsum(pc.binary_length(texts).to_numpy()) // most
    cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(texts)]
    yield from ((a, texts.slice(a, b - a)) for a, b in zip(cuts, cuts[1:]) if b > a)


def pieces_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(pieces of all texts, number of pieces of each).

    Texts are cut before white space and between a letter and a mark, where no token reaches across.
    """
    buffer, lengths = joined_bytes(texts)
    starts = np.zeros(len(buffer) + 1, bool)
    if len(buffer):
        kind = _KINDS[buffer]
        starts[1:-1] = ((kind[1:] == _SPACE) & (kind[:-1] != _SPACE)) | ((kind[1:] == _MARK) & (kind[:-1] == _LETTER))
        after = np.flatnonzero((kind[2:] == _MARK) & (kind[1:-1] == _TAIL)) + 2
        starts[after[buffer[after - 2] == 0xC3]] = True
    return cut_at(buffer, starts, offsets_of(lengths))


def cores_of(pieces: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(pieces without white space around them, whether each is one word of plain letters)."""
    core = pc.ascii_trim_whitespace(pieces)
    return core, pc.match_substring_regex(core, PLAIN).to_numpy(zero_copy_only=False)


class PieceEncoder:
    """Ids of texts from ids of words and of other pieces, as arrays: (flat ids, number of ids of each).

    ``encode_words`` gives the ids of words in lower case, ``encode_odd`` those of any other pieces.
    Both meet only what is not among the ``most`` words, and pieces, that are remembered.
    """

    def __init__(self, encode_words: Callable, encode_odd: Callable, most: int):
        self.encode_odd = encode_odd
        self.pieces, self.words = WordMemory(self._new_pieces, most), WordMemory(encode_words, most)

    def _new_pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        core, plain = cores_of(pieces)
        known, sizes = self.words.ids_of(pc.utf8_lower(core.filter(pa.array(plain))))
        odd, odd_sizes = self.encode_odd(core.filter(pa.array(~plain)))
        lengths = np.empty(len(pieces), np.int64)
        lengths[plain], lengths[~plain] = sizes, odd_sizes
        starts = np.empty(len(pieces), np.int64)
        starts[plain], starts[~plain] = np.cumsum(sizes) - sizes, len(known) + np.cumsum(odd_sizes) - odd_sizes
        return gather(np.concatenate([known, odd]), starts, lengths), lengths

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each)."""
        pieces, counts = pieces_of(texts)
        ids, sizes = self.pieces.ids_of(pieces)
        return ids, np.diff(offsets_of(sizes)[offsets_of(counts)])
