"""Vectorised text scanning shared by the operators of this subpackage.

A word is a maximal run of letters, marks, digits and underscores, lower-cased; everything else, Unicode's blanks and punctuation
too, separates words. In scripts that set no blanks between words, each character (with the marks on it) is a word of its own.
Words are 64-bit hashes, computed for a whole Arrow column at once: no Python object is made per word.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: The same words in the regular expressions of DuckDB and Java, as long as all characters beyond ASCII are letters of scripts with blanks.
WORD_SQL = r"[0-9a-z_\x{80}-\x{10FFFF}]+"
#: Bytes of text that one vectorised step handles; a longer text is a step of its own.
STEP_BYTES = 1 << 19

_LONG = 48
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(33))) * _M1
    x = (x ^ (x >> np.uint64(33))) * _M2
    return x ^ (x >> np.uint64(33))


_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)  # the lowest k bytes
IS_WORD = np.zeros(256, bool)
IS_WORD[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = True
#: Blocks of scripts without blanks between words: Thai and Lao, Myanmar, Khmer, Tai, Balinese, Javanese, kana, bopomofo and Han.
UNSPACED = (
    (0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19DF), (0x1A20, 0x1AAF), (0x1B00, 0x1B7F), (0x2E80, 0x2FDF), (0x3005, 0x3007),
    (0x3021, 0x312F), (0x31A0, 0x31BF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xA980, 0xA9FF), (0xAA60, 0xAADF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x1AFF0, 0x1B16F), (0x20000, 0x3FFFF),
)
#: Kinds of characters: between words, part of a word, a word of its own, mark on such a one.
BETWEEN, PART, ALONE, ON_ALONE = range(4)


@lru_cache(maxsize=1)
def kinds() -> np.ndarray:
    """The kind of each code point. Joiners and soft hyphens are parts of words, and so is what Unicode doesn't name yet."""
    out = np.full(0x110000, PART, np.uint8)
    for first, last in UNSPACED:
        out[first : last + 1] = ALONE
    for c in (*range(0x80, 0x3400), *range(0xA000, 0xAC00), *range(0xD7B0, 0x20000), *range(0xE0000, 0xE01F0)):
        category = unicodedata.category(chr(c))
        if category[0] in "PSZ" or category == "Cc" or 0xFE00 <= c <= 0xFE0F or 0xE0100 <= c or (category == "Cf" and c not in (0xAD, 0x200C, 0x200D)):
            out[c] = BETWEEN
        elif out[c] == ALONE and category in ("Mn", "Mc", "Nd"):
            out[c] = PART if category == "Nd" else ON_ALONE
    return out


@dataclass
class Words:
    """Words of several texts: hash, byte span, and where each text's words begin (len(texts) + 1 offsets)."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    ptr: np.ndarray
    data: np.ndarray

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ptr) - 1), np.diff(self.ptr))


def strings(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One contiguous array without nulls (a null text reads as an empty one)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.type not in (pa.string(), pa.large_string()):
        column = column.cast(pa.string())
    return pc.fill_null(column, "") if column.null_count else column


def lengths(column: pa.Array) -> np.ndarray:
    return pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)


def steps(column: pa.Array, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts hold about ``most`` bytes together."""
    total = np.cumsum(lengths(column))
    at = 0
    while at < len(column):
        before = int(total[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(total, before + most, "right")))
        yield at, min(to, len(column))
        at = to


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = 8 * STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that what is held for one stays small; a longer text is a batch of its own."""
    for batch in batches:
        for a, z in steps(strings(batch.column(text)), most):
            yield batch.slice(a, z - a)
        pa.default_memory_pool().release_unused()  # the next batch may take it from elsewhere


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts on end, and the offset of each."""
    sizes = np.zeros(len(column) + 1, np.int64)
    np.cumsum(lengths(column), out=sizes[1:])
    if not sizes[-1]:
        return np.zeros(0, np.uint8), sizes
    wide = np.int64 if column.type == pa.large_string() else np.int32
    first = int(np.frombuffer(column.buffers()[1], wide)[column.offset])
    return np.frombuffer(column.buffers()[2], np.uint8)[first : first + int(sizes[-1])], sizes


def spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of bytes that ``table`` marks, cut where a text ends."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = table[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins = inside & (np.r_[True, ~inside[:-1]] | edge[:-1])
    ends = inside & (np.r_[~inside[1:], True] | edge[1:])
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First bytes of words, and the bytes behind them, in UTF-8."""
    at = np.flatnonzero(data >= 0xC0)
    lead, last = data[at].astype(np.int32), len(data) - 1
    width = 2 + (lead >= 0xE0) + (lead >= 0xF0)
    code = lead & (0x7F >> width)
    for k in range(1, 4):
        code = np.where(width > k, code << 6 | data[np.minimum(at + k, last)] & 0x3F, code)
    kind = kinds()[np.minimum(code, 0x10FFFF)]
    odd = kind != PART
    if not odd.any():
        return spans(data, offsets, IS_WORD)
    at, width, kind = at[odd], width[odd], kind[odd]
    of = IS_WORD[data].astype(np.uint8)
    for k in range(4):
        of[np.minimum(at + k, last)[width > k]] = kind[width > k]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.r_[np.uint8(BETWEEN), of[:-1]]
    begins = (of != BETWEEN) & (edge[:-1] | (before == BETWEEN) | ((of == PART) & (before >= ALONE)))
    begins[at[kind == ALONE]] = True
    ends = (of != BETWEEN) & (np.r_[of[1:] == BETWEEN, True] | edge[1:] | np.r_[begins[1:], True])
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    size = end - start
    h = size.astype(np.uint64) * _STEP
    if not len(start):
        return h
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.as_strided(padded[:8].view(np.uint64), (len(data),), (1,))  # the 8 bytes from each place
    h = (h ^ (eight[start] & _KEEP[np.minimum(size, 8)])) * _M1
    h ^= h >> np.uint64(32)
    at = np.flatnonzero((size > 8) & (size <= _LONG))
    for k in range(8, _LONG, 8):
        if not len(at):
            break
        x = (h[at] ^ (eight[start[at] + k] & _KEEP[np.minimum(size[at] - k, 8)])) * _M1
        h[at] = x ^ (x >> np.uint64(32))
        at = at[size[at] > k + 8]
    for i in np.flatnonzero(size > _LONG):
        h[i] = xxhash.xxh64_intdigest(data[start[i] : end[i]].tobytes())
    return mix(h)


def words(column: pa.Array) -> Words:
    data, offsets = raw(pc.utf8_lower(column))
    start, end = word_spans(data, offsets)
    ptr = np.searchsorted(start, offsets).astype(np.int64)
    return Words(hash_spans(data, start, end), start, end, ptr, data)


def hash_word(word: str) -> int:
    return int(words(pa.array([word])).hash[0])


def window_hash(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words that begin at each place; len(h) - size + 1 of them."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    # doubling: the hash of 2k words comes from two hashes of k words
    block, width, out, done = h, 1, None, 0
    left = size
    while left:
        if left & 1:
            piece = block[done : done + n]
            out = piece.copy() if out is None else mix(out * _M2 + piece)
            done += width
        left >>= 1
        if left:
            block = mix(block[:-width] * _STEP + block[width:] + np.uint64(width))
            width *= 2
    return out


def whole(ptr: np.ndarray, size: int) -> np.ndarray:
    """Marks the places from which ``size`` words lie within one text (for window_hash's result)."""
    n = int(ptr[-1]) - size + 1
    if n <= 0:
        return np.zeros(0, bool)
    ok = np.ones(int(ptr[-1]), bool)
    for k in range(1, size):
        at = ptr[1:] - k
        ok[at[at >= ptr[:-1]]] = False
    return ok[:n]
