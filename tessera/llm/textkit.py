"""Vectorised text primitives shared by the operators of this subpackage.

Everything here works on the contiguous UTF-8 buffer of an Arrow string column, so that splitting
and hashing words costs a few numpy passes instead of a Python object for every word.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``; a null text counts as an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text that one numpy pass handles; bounds the working memory of a task.
BLOCK_BYTES = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: Odd multipliers of the position-dependent sums behind n-gram hashes.
_STEP = U64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (the finaliser of splitmix64)."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of about ``limit`` bytes of text: (first row, end row, bytes, offsets).

    A row is never cut: one longer than the limit makes a block of its own.
    """
    raw, offs = utf8(column)
    n, row = len(offs) - 1, 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offs, offs[row] + limit, side="right")) - 1)
        end = min(end, n)
        yield row, end, raw[offs[row] : offs[end]], offs[row : end + 1] - offs[row]
        row = end


class Words:
    """The words of a block of texts.

    ``start`` and ``end`` are byte ranges; the words of row r are ``first[r]:first[r + 1]``.
    """

    def __init__(self, raw: np.ndarray, offs: np.ndarray, lower: bool = False):
        self.raw = _LOWER[raw] if lower else raw
        ink = ~_SPACE[raw]
        edge = np.zeros(len(raw) + 1, dtype=bool)
        edge[offs] = True
        before = np.empty(len(raw), dtype=bool)
        if len(raw):
            before[0] = False
            before[1:] = ink[:-1]
            before &= ~edge[:-1]
            after = np.empty(len(raw), dtype=bool)
            after[-1] = False
            after[:-1] = ink[1:]
            after &= ~edge[1:]
            self.start = np.flatnonzero(ink & ~before)
            self.end = np.flatnonzero(ink & ~after) + 1
        else:
            self.start = self.end = np.zeros(0, np.int64)
        self.first = np.searchsorted(self.start, offs)
        self.rows = len(offs) - 1

    def __len__(self) -> int:
        return len(self.start)

    def row_of(self) -> np.ndarray:
        """Row of each word."""
        return np.repeat(np.arange(self.rows), np.diff(self.first))

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each word."""
        return hash_ranges(self.raw, self.start, self.end, seed)


#: Steps of eight bytes that all ranges take together.
LONG = 512


def hash_ranges(raw: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of byte ranges: eight bytes a step for all ranges at once, and what lies beyond ``LONG`` steps by one sum for each range."""
    padded = np.empty(len(raw) + 8, dtype=np.uint8)
    padded[: len(raw)] = raw
    padded[len(raw) :] = 0
    eights = np.ndarray(shape=(len(raw) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    left = (end - start).astype(np.int64)
    out = mix(left.astype(U64) + U64((seed * int(_STEP) + 1) % (1 << 64)))
    at, rows, steps = start, None, 0
    while len(at):
        if steps == LONG:
            out[rows] = mix(out[rows] ^ np.array([_rest(eights, int(a), int(n)) for a, n in zip(at, left)], dtype=U64))
            break
        steps += 1
        chunk = eights[at]
        short = left < 8
        if short.any():
            keep = (U64(1) << (U64(8) * np.minimum(left, 7).astype(U64))) - U64(1)
            chunk = np.where(short, chunk & keep, chunk)
        if rows is None:
            out = mix((out ^ chunk) * _STEP)
        else:
            out[rows] = mix((out[rows] ^ chunk) * _STEP)
        more = left > 8
        rows = np.flatnonzero(more) if rows is None else rows[more]
        at, left = at[more] + 8, left[more] - 8
    return out


def _rest(eights: np.ndarray, at: int, left: int) -> np.uint64:
    """Sum of mixed eights, each with its place, for a range of many bytes; the last eight is cut to the bytes that are left."""
    total, lanes = np.zeros(1, U64), -(-left // 8)
    for i in range(0, lanes, 65536):
        place = np.arange(i, min(i + 65536, lanes), dtype=np.int64)
        chunk = eights[at + 8 * place]
        if left % 8 and place[-1] == lanes - 1:
            chunk[-1] &= (U64(1) << U64(8 * (left % 8))) - U64(1)
        total += mix(chunk ^ mix((place.astype(U64) + U64(1)) * _STEP)).sum(dtype=U64)
    return total[0]


class Ranges:
    """Hashes and letter sketches of any byte ranges of a block, from prefix sums.

    The hash is polynomial modulo 2^64, so a range costs two look-ups whatever its length.  The
    sketch has a bit for the parity of each of 32 classes of bytes, and one for each of 32 classes
    of neighbouring bytes: one edit changes at most two of the first and four of the second.
    """

    _power = _inverse = np.ones(1, U64)

    def __init__(self, raw: np.ndarray):
        """``raw`` holds bytes, code points or hashes of words."""
        n = len(raw)
        if len(Ranges._power) <= n:
            for name, base in (("_power", 0x9E3779B97F4A7C15), ("_inverse", pow(0x9E3779B97F4A7C15, -1, 1 << 64))):
                powers = np.full(n + 1, U64(base))
                powers[0] = 1
                setattr(Ranges, name, np.multiply.accumulate(powers))
        self.sums = np.zeros(n + 1, U64)
        np.cumsum((raw.astype(U64) + U64(1)) * Ranges._power[:n], out=self.sums[1:])
        self.raw = raw

    @cached_property
    def letters(self) -> np.ndarray:
        out = np.zeros(len(self.raw) + 1, np.uint32)
        np.bitwise_xor.accumulate(_BIT[(self.raw & self.raw.dtype.type(31)).astype(np.int64)], out=out[1:])
        return out

    @cached_property
    def pairs(self) -> np.ndarray:
        out, of = np.zeros(len(self.raw) + 1, np.uint32), self.raw.dtype.type
        if len(self.raw):
            np.bitwise_xor.accumulate(_BIT[((self.raw[1:] * of(7) + self.raw[:-1] * of(3)) & of(31)).astype(np.int64)], out=out[2:])
        return out

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * Ranges._inverse[start] ^ (end - start).astype(U64))

    def sketches(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Letter parities in the low half, pair parities in the high half."""
        letters = self.letters[end] ^ self.letters[start]
        pairs = np.where(end > start, self.pairs[end] ^ self.pairs[np.minimum(start + 1, len(self.pairs) - 1)], 0)
        return letters.astype(U64) | pairs.astype(U64) << U64(32)


_BIT = (np.uint32(1) << np.arange(32, dtype=np.uint32)).astype(np.uint32)


def code_points(raw: np.ndarray) -> np.ndarray:
    """Code points before each byte of UTF-8, and in the end."""
    out = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=out[1:])
    return out


def symbols(raw: np.ndarray) -> np.ndarray:
    """A number for each code point of UTF-8: its bytes."""
    first = np.flatnonzero((raw & 0xC0) != 0x80)
    if len(first) == len(raw):
        return raw.astype(np.uint32)
    padded = np.concatenate([raw, np.zeros(4, np.uint8)])
    fours = np.ndarray(shape=(len(raw) + 1,), dtype="<u4", buffer=padded, strides=(1,))
    size = np.minimum(np.diff(np.concatenate([first, [len(raw)]])), 4)
    return fours[first] & np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)[size]


def may_be_within(a: np.ndarray, b: np.ndarray, edits: int | np.ndarray) -> np.ndarray:
    """Whether sketches leave room for so few edits; never false for ranges that are within them."""
    apart = a ^ b
    return (np.bitwise_count(apart & U64(0xFFFFFFFF)) <= 2 * edits) & (np.bitwise_count(apart >> U64(32)) <= 4 * edits)


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Order-dependent hashes of n consecutive word hashes; empty if there are fewer."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, U64)
    total = np.zeros(m, U64)
    for k in range(n):
        total *= _STEP
        total += hashes[k : k + m]
    return mix(total)


def windows(first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For row ranges of words, those positions of n-grams that stay inside a row, and how many each row has."""
    counts = np.maximum(np.diff(first) - n + 1, 0)
    total = int(counts.sum())
    ends = np.cumsum(counts)
    inside = np.arange(total) - np.repeat(ends - counts, counts)
    return np.repeat(first[:-1], counts) + inside, counts


def ragged(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from its flat values and the length of each row."""
    offsets = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))
