"""Line deduplication with a segment-partition edit join.

A line is what stands between line feeds, without white space at its ends.  A line that is not blank
is removed where

* the same line occurs earlier (smaller doc_id, or higher up in the same document), or
* it is *near* another line whose first place is earlier.

Two lines are near if one of two rules links them, so the edits allowed grow with length:

* words: both have at least 10 words, and at most one edit (of whole words) for every ten words of
  the shorter one separates them, ``WORD_EDITS`` at most;
* characters: both have fewer than ``FEW_WORDS`` words, from ``LEAST`` to ``MOST`` code points, and
  at most ``CHAR_EDITS`` edits of code points separate them.

Lines are judged on the input, so a removed line still counts as an earlier one.

1. Distinct lines: a digest of 128 bits stands for a line; its first place is an aggregate.
2. Each distinct line is split into threshold + 1 segments of even length.  Two lines within the
   threshold share a segment at nearly the same place, so a line enters its segments into an index
   keyed by (length, segment number, segment) and probes the index of each length from its own down
   to threshold less, with the substrings that multi-match-aware bounds leave.  Keys travel as packed
   arrays of 12 bytes each, a bucket of the key's hash at a time, and meet in a sort; the number of
   buckets follows the number of lines.
3. Lines of candidate pairs are fetched from their first place and verified with a banded bit-parallel
   automaton: one bit for each diagonal within the threshold, one vector for each number of edits.
4. A key that more than ``RUN`` lines share, such as a template's, makes no pairs.  Its lines form a
   *cell*, cut into blocks of ``CELL_LINES``, any two of which meet in a task of their own, where each
   line in order of its place is compared with those after it that are still kept; sketches of the bag
   of words or letters skip most.  A cell returns at most one row for each of its lines.

Defined cases: a null or empty text has no lines to judge and stays as it is; blank lines stay; rows
that repeat doc_id and text are one document; a null doc_id ranks behind every other; a text of many
megabytes is split into lines first, so that only a single such line makes a large block; empty
tables give empty results; other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import scratch, ship, textkit
from tessera.llm.substring import NO_ID, keyed

#: Words for each edit of the word rule, its most edits, and the words from which the character rule ends.
WORDS_PER_EDIT, WORD_EDITS, FEW_WORDS = 10, 4, 20
CHAR_EDITS, LEAST, MOST = 2, 24, 1 << 20
#: Lines that share a key from which they form a cell; lines of a block of a cell, and bytes of it that are compared at once.
RUN, CELL_LINES, CELL_BYTES = 64, 2000, 2 << 20
#: Bytes of packed keys that one bucket and one partition should hold, and the most partitions.
BUCKET_BYTES, PARTITION_BYTES, PARTITIONS = 4 << 20, 32 << 20, 20_000
WHITE = b" \t\n\x0b\x0c\r"
U64 = np.uint64
_PACKED = np.dtype([("key", "<u4"), ("line", "<u8")])
_INDEX, _PROBE, _KEY = np.uint32(1 << 31), np.uint32(1 << 30), np.uint32((1 << 30) - 1)


def word_edits(words: np.ndarray) -> np.ndarray:
    """Edits that the word rule allows for the shorter line's number of words."""
    return np.minimum(words // WORDS_PER_EDIT, WORD_EDITS)


def segments(length: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and sizes (lines, parts) of an even partition, the longer segments last."""
    small, longer = length // parts, length % parts
    i = np.arange(parts)[None, :]
    size = small[:, None] + (i >= parts - longer[:, None])
    return np.cumsum(size, axis=1) - size, size


def join_keys(ranges: textkit.Ranges, start: np.ndarray, end: np.ndarray, edits: Callable[[np.ndarray], np.ndarray], most: int, salt: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray, bool, bool]]:
    """(lines, keys, whether they index, whether they probe) for some lines, given as ranges of symbols.

    ``edits`` gives the threshold for a length, at most ``most``; lines of threshold 0 take no part.  The
    segment that a line looks up at its own place and length is the one it indexes, and comes once.
    """
    length = end - start

    def key(at: np.ndarray, size: np.ndarray, other: np.ndarray, part: int) -> np.ndarray:
        return textkit.mix(ranges.hashes(at, at + size) + other.astype(U64) * U64(1009) + U64(part + 64 * salt))

    for shorter in range(most + 1):
        allowed = edits(length - shorter)
        for threshold in range(max(1, shorter), most + 1):
            lines = np.flatnonzero((allowed == threshold) & (length - shorter > threshold))
            if not len(lines):
                continue
            other, own, first = length[lines] - shorter, length[lines], start[lines]
            offset, size = segments(other, threshold + 1)
            for i in range(threshold + 1):
                # Places that both ends allow: i edits at most before the segment, threshold - i after it.
                for shift in range(max(-i, shorter - (threshold - i)), min(i, shorter + (threshold - i)) + 1):
                    at = offset[:, i] + shift
                    ok = np.flatnonzero((at >= 0) & (at + size[:, i] <= own))
                    if len(ok):
                        yield lines[ok], key((first + at)[ok], size[ok, i], other[ok], i), shorter == shift == 0, True


def digest(line: bytes) -> bytes:
    return blake2b(line, digest_size=16).digest()


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers and digests of the lines of each text that are not blank."""
    for batch in batches:
        numbers, digests, counts = [], [], []
        for text in batch.column("text").to_pylist():
            lines = [(n, x) for n, line in enumerate(text.split(b"\n")) if (x := line.strip(WHITE))]
            numbers += [n for n, _ in lines]
            digests += [digest(x) for _, x in lines]
            counts.append(len(lines))
        both, counts = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2), np.array(counts, np.int64)
        part = batch.filter(pa.array(counts > 0))
        counts = counts[counts > 0]
        yield pa.RecordBatch.from_arrays(
            [part.column("k"), part.column("th"), textkit.ragged(np.array(numbers, np.int32), counts, pa.int32()), *(textkit.ragged(np.ascontiguousarray(both[:, i]), counts, pa.int64()) for i in (0, 1))],
            names=["k", "th", "no", "h", "g"],
        )


def _keys(lines: list[bytes], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of some distinct lines, whose they are, and flags."""
    raw, offs = textkit.utf8(pa.array(lines, pa.binary()))
    words = textkit.Words(raw, offs)
    n_words, size = np.diff(words.first), textkit.code_points(raw)
    keys, owners, flags = [], [], []

    def add(found: Iterator[tuple[np.ndarray, np.ndarray, bool, bool]], who: np.ndarray) -> None:
        for own, key, index, probe in found:
            keys.append(key)
            owners.append(ids[who[own]])
            flags.append(np.full(len(own), index * _INDEX + probe * _PROBE, np.uint32))

    many = np.flatnonzero(n_words >= WORDS_PER_EDIT)
    if len(many):
        add(join_keys(textkit.Ranges(words.hashes()), words.first[many], words.first[many + 1], word_edits, WORD_EDITS, 1), many)
    points = size[offs[1:]] - size[offs[:-1]]
    few = np.flatnonzero((n_words < FEW_WORDS) & (points >= LEAST) & (points <= MOST))
    if len(few):
        lengths = np.diff(offs)[few]
        at = np.repeat(offs[few] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
        ends = np.cumsum(points[few])
        add(join_keys(textkit.Ranges(textkit.symbols(raw[at])), ends - points[few], ends, lambda n: np.where(n >= LEAST, CHAR_EDITS, 0), CHAR_EDITS, 2), few)
    if not keys:
        return np.zeros(0, U64), np.zeros(0, U64), np.zeros(0, np.uint32)
    return np.concatenate(keys), np.concatenate(owners), np.concatenate(flags)


def _pack(batches: Iterator[pa.RecordBatch], buckets: int, block: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Keys of the distinct lines of each block, packed by bucket."""
    held: dict[int, bytes] = {}

    def drain() -> Iterator[pa.RecordBatch]:
        key, line, flags = _keys(list(held.values()), np.fromiter(held, np.int64, len(held)).view(U64))
        held.clear()
        bucket = (key % U64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.int64)  # few of them are sorted by radix
        order = np.argsort(bucket, kind="stable")
        entries = np.empty(len(key), _PACKED)
        entries["key"], entries["line"] = ((key >> U64(34)).astype(np.uint32) | flags)[order], line[order]
        bucket = bucket[order].astype(np.int64)
        edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=buckets))
        if len(key):
            yield pa.RecordBatch.from_arrays([pa.array(bucket[edges[:-1]]), pa.array([entries[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:])], pa.binary())], names=["bucket", "packed"])

    size = 0
    for batch in batches:
        for text in batch.column("text").to_pylist():
            for line in text.split(b"\n"):
                line = line.strip(WHITE)
                if len(line) >= 2 * WORDS_PER_EDIT - 1:  # neither rule takes shorter ones
                    g = int.from_bytes(digest(line)[8:], "little", signed=True)
                    if g not in held:
                        held[g] = line
                        size += len(line)
                        if size >= block:
                            yield from drain()
                            size = 0
    if held:
        yield from drain()


def _shared(entries: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """Entries whose key another entry has too, or that is among ``gone``: the others make neither pairs nor cells."""
    key = np.ascontiguousarray(entries["key"] & _KEY)
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    both = np.zeros(len(key), bool)
    both[order[1:]] = same
    both[order[:-1]] |= same
    return entries[both | np.isin(key, gone)] if len(gone) else entries[both]


def _settled(entries: np.ndarray) -> np.ndarray:
    """Entries sorted by key, then line; the flags of equal ones together."""
    key = entries["key"] & _KEY
    order = np.lexsort((entries["line"], key))
    entries, key = entries[order], key[order]
    new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (entries["line"][1:] != entries["line"][:-1])]))
    out = entries[new]
    out["key"] = np.bitwise_or.reduceat(entries["key"], new)
    return out


def _runs(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of the runs of one key."""
    key = entries["key"] & _KEY
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return start, np.diff(np.concatenate([start, [len(key)]]))


def _members(bucket: int, entries: np.ndarray, cell_lines: int) -> pa.RecordBatch:
    """Lines of hot keys: the cell, the line and the number of blocks of the cell, 0 where it is not known yet."""
    line, key = np.ascontiguousarray(entries["line"]).view(np.int64), (entries["key"] & _KEY).astype(np.int64)
    if cell_lines:
        _, at, many = np.unique(key, return_inverse=True, return_counts=True)
        blocks = -(-many // cell_lines)[at]
    else:
        blocks = np.zeros(len(key), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(key | (bucket << 30)), pa.array(line), pa.array(blocks)], names=["cell", "a", "b"])


def _pairs(entries: np.ndarray, run: int) -> np.ndarray:
    """Pairs of lines of short runs, of which one probes a segment that the other indexes."""
    start, length = _runs(entries)
    short = np.flatnonzero((length > 1) & (length <= run))
    found = []
    at, left = start[short], length[short]
    place = np.repeat(at - (np.cumsum(left) - left), left) + np.arange(left.sum())
    end = np.repeat(at + left, left)
    for gap in range(1, int(left.max(initial=1))):
        live = place + gap < end
        place, end = place[live], end[live]
        a, b = entries[place], entries[place + gap]
        meets = ((a["key"] & _INDEX > 0) & (b["key"] & _PROBE > 0)) | ((b["key"] & _INDEX > 0) & (a["key"] & _PROBE > 0))
        found.append(np.stack([a["line"][meets], b["line"][meets]], axis=1))
    both = np.concatenate(found) if found else np.zeros((0, 2), U64)
    return np.unique(np.ascontiguousarray(both).view([("a", U64), ("b", U64)]).ravel()).view(U64).reshape(-1, 2)


def _meet(batches: Iterator[pa.RecordBatch], run: int, cell_lines: int, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Candidate pairs (cell is null) and members of cells, from buckets in order, a bounded number of entries at a time.

    A bucket above ``limit`` entries is sorted early, and its keys that have become hot leave as cells of
    unknown size, so what is held follows the keys of a bucket and not the lines of a key.
    """
    held: list[np.ndarray] = []
    gone = np.zeros(0, np.uint32)  # keys that left early
    now, count, bound = -1, 0, limit

    def settle(last: bool) -> tuple[list[pa.RecordBatch], np.ndarray]:
        nonlocal gone
        entries = np.concatenate(held)
        if last:
            entries = _shared(entries, gone)
            if not len(entries):
                return [], entries
        entries = _settled(entries)
        start, length = _runs(entries)
        key = entries["key"] & _KEY
        early = np.isin(key, gone)
        hot = np.isin(key, key[start[length > run]]) & ~early
        if not last:
            gone = np.union1d(gone, key[start[length > run]])
            early |= hot
            hot = np.zeros(len(key), bool)
        return [_members(now, entries[which], blocks) for which, blocks in ((early, 0), (hot, cell_lines)) if which.any()], entries[~early & ~hot]

    def close() -> Iterator[pa.RecordBatch]:
        if held:
            out, rest = settle(True)
            yield from out
            both = _pairs(rest, run) if len(rest) else np.zeros((0, 2), U64)
            for s in range(0, len(both), 1 << 16):
                part = np.ascontiguousarray(both[s : s + (1 << 16)]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.nulls(len(part), pa.int64()), pa.array(part[:, 0]), pa.array(part[:, 1])], names=["cell", "a", "b"])

    for batch in batches:
        for bucket, packed in zip(batch.column("bucket").to_pylist(), batch.column("packed")):
            if bucket != now:
                yield from close()
                held, gone, now, count, bound = [], np.zeros(0, np.uint32), bucket, 0, limit
            held.append(np.frombuffer(packed.as_buffer(), _PACKED).copy())
            count += len(held[-1])
            if count >= bound:
                out, rest = settle(False)
                yield from out
                held, count = [rest], len(rest)
                bound = max(limit, 2 * count)
    yield from close()


def distances(a: list[np.ndarray], b: list[np.ndarray], most: int) -> np.ndarray:
    """Edit distance of each pair of symbol arrays, or ``most`` + 1 beyond it: banded, bit-parallel, all pairs at once.

    Bit d of ``reach[e]`` says that after i symbols of a and i + d - most symbols of b at most e edits were needed.
    """
    n = len(a)
    out = np.full(n, most + 1)
    if not n:
        return out
    la = np.array([len(x) for x in a], np.int64)
    order = np.argsort(la, kind="stable")  # the shortest first: those that are done make a prefix
    a, b, la = [a[i] for i in order], [b[i] for i in order], la[order]
    lb = np.array([len(x) for x in b], np.int64)
    width, band = int(la[-1]), 2 * most + 1
    bits = np.uint16 if band <= 16 else U64
    m = np.minimum(lb, width + band)

    def columns(lines: list[np.ndarray], size: np.ndarray, before: int, rows: int) -> np.ndarray:
        """Symbol i of line k at (before + i, k), and around them what is no code point and, as all bits are set, no word's hash either."""
        kind, at = lines[0].dtype, np.arange(rows) - before
        table = np.full((n, rows), np.iinfo(kind).max, kind)
        table[(at >= 0) & (at < size[:, None])] = np.concatenate([x[:k] for x, k in zip(lines, size)])
        return np.ascontiguousarray(table.T)

    A, B = columns(a, la, 0, width), columns(b, m, most, width + 2 * band)
    live = np.searchsorted(la, np.arange(width), side="right")
    mask, one, places = bits((1 << band) - 1), bits(1), np.arange(band, dtype=bits)[:, None]
    reach = np.stack([np.full(n, ((1 << (e + 1)) - 1) << most & int(mask), bits) for e in range(most + 1)])  # insertions before the first symbol
    for i, s in enumerate(live.tolist()):
        match = np.bitwise_or.reduce((B[i : i + band, s:] == A[i, s:]).astype(bits) << places, axis=0)
        old = reach[0, s:].copy()
        reach[0, s:] &= match
        for e in range(1, most + 1):
            new = (reach[e, s:] & match) | old | old >> one | (reach[e - 1, s:] << one) & mask
            old = reach[e, s:].copy()
            reach[e, s:] = new
    gap = lb - la + most
    inside = (gap >= 0) & (gap < band)
    bit = np.clip(gap, 0, band - 1).astype(bits)
    for e in range(most, -1, -1):
        out[order[inside & (reach[e] >> bit & one == 1)]] = e
    return out


def parities(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each row of words, 256 bits (rows, 4): the parity of each class of words.  An edit changes two bits at most."""
    bits = np.zeros((len(hashes) + 1, 4), U64)
    bits[np.arange(1, len(hashes) + 1), (hashes >> U64(6) & U64(3)).astype(np.int64)] = U64(1) << (hashes & U64(63))
    np.bitwise_xor.accumulate(bits, axis=0, out=bits)
    return bits[first[1:]] ^ bits[first[:-1]]


class Spelled:
    """Some lines as arrays of word hashes and of code points."""

    def __init__(self, lines: list[bytes]):
        raw, offs = textkit.utf8(pa.array(lines, pa.binary()))
        words = textkit.Words(raw, offs)
        hashes = words.hashes()
        size = textkit.code_points(raw)
        self.n_words, self.n_points = np.diff(words.first), size[offs[1:]] - size[offs[:-1]]
        self.words = [hashes[a:b] for a, b in zip(words.first[:-1], words.first[1:])]
        self.by_words = self.n_words >= WORDS_PER_EDIT
        self.by_points = (self.n_words < FEW_WORDS) & (self.n_points >= LEAST) & (self.n_points <= MOST)
        self.word_sketch = parities(hashes, words.first)
        # Only lines that the character rule takes are spelled in code points.
        few = np.flatnonzero(self.by_points)
        points = textkit.symbols(raw[np.repeat(self.by_points, np.diff(offs))])
        ends = np.cumsum(self.n_points[few])
        self.points: list[np.ndarray] = [points[:0]] * len(lines)
        for i, a, b in zip(few.tolist(), ends - self.n_points[few], ends):
            self.points[i] = points[a:b]
        self.point_sketch = np.zeros(len(lines), U64)
        self.point_sketch[few] = textkit.Ranges(points).sketches(ends - self.n_points[few], ends)

    def may_be_near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Pairs that sizes and sketches leave to the word rule, and to the character rule."""
        limit = word_edits(np.minimum(self.n_words[a], self.n_words[b]))
        words = np.flatnonzero(self.by_words[a] & self.by_words[b] & (np.abs(self.n_words[a] - self.n_words[b]) <= limit))
        words = words[np.bitwise_count(self.word_sketch[a[words]] ^ self.word_sketch[b[words]]).sum(axis=1) <= 2 * limit[words]]
        points = np.flatnonzero(self.by_points[a] & self.by_points[b] & (np.abs(self.n_points[a] - self.n_points[b]) <= CHAR_EDITS))
        points = points[textkit.may_be_within(self.point_sketch[a[points]], self.point_sketch[b[points]], CHAR_EDITS)]
        out = np.zeros((2, len(a)), bool)
        out[0, words], out[1, points] = True, True
        return out

    def near(self, a: np.ndarray, b: np.ndarray, cells: int = 1 << 20) -> np.ndarray:
        """Whether the lines of each pair are near; pairs of like length are verified together, as many as fit into so many cells."""
        out = np.zeros(len(a), bool)
        limits = word_edits(np.minimum(self.n_words[a], self.n_words[b])), np.full(len(a), CHAR_EDITS)
        for arrays, size, use, limit in zip((self.words, self.points), (self.n_words, self.n_points), self.may_be_near(a, b), limits):
            todo = np.flatnonzero(use & ~out)
            todo = todo[np.lexsort((size[a[todo]], limit[todo]))]
            end = len(todo)
            while end:  # the longest first, so that each group is as wide as its first pair
                most = int(limit[todo[end - 1]])
                start = max(int(np.searchsorted(limit[todo[:end]], most)), end - max(1, cells // (int(size[a[todo[end - 1]]]) + 1)))
                pick, end = todo[start:end], start
                out[pick] |= distances([arrays[i] for i in a[pick]], [arrays[i] for i in b[pick]], most) <= most
        return out


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Wanted lines (number, digest) of each text."""
    for batch in batches:
        for text, *rest in zip(*(batch.column(c).to_pylist() for c in ("text", "k", "th", "want"))):
            k, th, want = rest
            lines = text.split(b"\n")
            cols = [[w[c] for w in want] for c in ("h", "g", "no")]
            found = [lines[n].strip(WHITE) for n in cols[2]]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((*cols[:2], [k] * len(want), [th] * len(want), cols[2], found), kinds)], names=["h", "g", "k", "th", "no", "line"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The later lines of candidate pairs that are near, a bounded number of bytes at a time."""
    for batch in batches:
        a, b = batch.column("la").to_pylist(), batch.column("lb").to_pylist()
        bytes_of = np.cumsum([len(x) + len(y) for x, y in zip(a, b)])
        at = 0
        while at < len(a):
            to = max(at + 1, int(np.searchsorted(bytes_of, (bytes_of[at - 1] if at else 0) + (3 << 20))))
            place: dict[bytes, int] = {}  # a line of several pairs is spelled once
            left, right = (np.array([place.setdefault(x, len(place)) for x in side[at:to]], np.int64) for side in (a, b))
            near = Spelled(list(place)).near(left, right)
            hit = batch.slice(at, to - at).filter(pa.array(near))
            yield pa.RecordBatch.from_arrays([hit.column("h"), hit.column("g")], names=["h", "g"])
            at = to


def later_near(x: Spelled, earlier: np.ndarray, later: np.ndarray, at_once: int = 1 << 18) -> np.ndarray:
    """Of the lines ``later``, whether each is near one of ``earlier`` that has a smaller number.

    Lines are compared with those that are still kept and whose sketches leave room, first one line with
    all, then twice as many at a time, up to a bounded number of pairs.
    """
    near, at, step = np.zeros(len(later), bool), 0, 1
    while at < len(earlier):
        live = np.flatnonzero(~near & (later > earlier[at]))
        if not len(live):
            break
        pivots = earlier[at : at + step]
        a, b = np.repeat(pivots, len(live)), np.tile(live, len(pivots))
        ok = np.flatnonzero((a < later[b]) & x.may_be_near(a, later[b]).any(axis=0))
        if len(ok):
            near[b[ok[x.near(a[ok], later[b[ok]])]]] = True
        at += len(pivots)
        step = max(1, min(2 * step, at_once // len(live)))
    return near


def _cell(group: pa.Table) -> pa.Table:
    """The lines of a cell that are near an earlier one of it, two chunks of bounded bytes at a time."""
    group = group.sort_by([("k", "ascending"), ("th", "ascending"), ("no", "ascending")]).select(["h", "g", "line"])
    lines = group.column("line").to_pylist()
    chunk = np.cumsum([len(line) for line in lines]) // CELL_BYTES
    edges = np.flatnonzero(np.diff(chunk, prepend=-1, append=chunk[-1] + 1))
    near = np.zeros(len(lines), bool)
    spans = list(zip(edges[:-1], edges[1:]))
    for i, (a, b) in enumerate(spans):
        for j, (c, d) in enumerate(spans[i:]):
            rest = np.arange(c, d)[~near[c:d]]
            if not j:
                near[rest] |= later_near(Spelled(lines[a:b]), np.arange(b - a), rest - a)
            elif len(rest):
                near[rest] |= later_near(Spelled(lines[a:b] + [lines[r] for r in rest]), np.arange(b - a), np.arange(b - a, b - a + len(rest)))
    return group.select(["h", "g"]).filter(pa.array(near))


def near_lines(rows: DataFrame, firsts: DataFrame, n_lines: int, run: int = RUN, cell_lines: int = CELL_LINES) -> DataFrame:
    """Digests (h, g) of the distinct lines that are near one whose first place is earlier."""
    keys_per_line, spark = 24, rows.sparkSession
    size = n_lines * keys_per_line * _PACKED.itemsize
    parts = int(min(PARTITIONS, max(spark.sparkContext.defaultParallelism, -(-size // PARTITION_BYTES))))
    buckets = parts * max(1, -(-size // (parts * BUCKET_BYTES)))
    packed = rows.mapInArrow(lambda it: _pack(it, buckets), "bucket long, packed binary")
    dealt = packed.repartitionById(parts, F.pmod("bucket", F.lit(parts)).cast("int")).sortWithinPartitions("bucket")
    met = scratch.table(dealt.mapInArrow(lambda it: _meet(it, run, cell_lines), "cell long, a long, b long").distinct(), "met", release=True)
    pairs, members = met.where("cell IS NULL").select("a", "b"), met.where("cell IS NOT NULL")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("g")).unionByName(members.select(F.col("a").alias("g"))).distinct()
    want = firsts.join(wanted, "g").select("first.k", "first.th", F.struct("first.no", "h", "g").alias("w")).groupBy("k", "th").agg(F.collect_list("w").alias("want"))
    # Two lines whose halves of a digest collide are both candidates; the digest as a whole tells them apart.
    texts = scratch.table(rows.join(want, ["k", "th"]).mapInArrow(_fetch, "h long, g long, k long, th long, no int, line binary"), "candidates", release=True).dropDuplicates(["h", "g"])
    place = F.struct("k", "th", "no")

    def side(x: str) -> DataFrame:
        return texts.select(F.col("g").alias(x), F.col("h").alias(f"h{x}"), place.alias(f"p{x}"), F.col("line").alias(f"l{x}"))

    later = F.col("pa") > F.col("pb")
    judged = pairs.join(side("a"), "a").join(side("b"), "b").select(F.when(later, F.col("ha")).otherwise(F.col("hb")).alias("h"), F.when(later, F.col("a")).otherwise(F.col("b")).alias("g"), "la", "lb")
    near = judged.mapInArrow(_verify, "h long, g long")
    if not members.isEmpty():
        # A line is fetched once for all its cells, of which there are no more than it has keys.
        of_line = members.groupBy(F.col("a").alias("g")).agg(F.collect_set(F.struct("cell", F.col("b").alias("nb"))).alias("cells"))
        spelled = texts.join(of_line, "g").select("h", "g", "k", "th", "no", "line", F.explode("cells").alias("c")).select("h", "g", "k", "th", "no", "line", "c.*")
        blocks = spelled.where("nb > 0")
        if not members.where("b = 0").isEmpty():
            sizes = members.where("b = 0").groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / cell_lines).alias("nb"))
            blocks = blocks.unionByName(spelled.where("nb = 0").drop("nb").join(sizes, "cell"))
        own = F.pmod(F.xxhash64("h", "g"), "nb")
        blocks = blocks.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)))
        cells = blocks.select("cell", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "h", "g", "k", "th", "no", "line")
        near = near.unionByName(cells.groupBy("cell", "x", "y").applyInArrow(_cell, "h long, g long"))
    return near.distinct()


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, cell_lines: int = CELL_LINES) -> DataFrame:
    """Line numbers to remove: k, th, gone (sorted array of int), for documents that lose any."""
    spark = docs.sparkSession
    ship.ensure(spark)
    rows = keyed(docs, id_col, text_col).withColumn("text", F.encode("text", "UTF-8"))
    lines = scratch.table(rows.mapInArrow(_lines, "k long, th long, no array<int>, h array<long>, g array<long>"), "lines")
    each = lines.select("k", "th", F.explode(F.arrays_zip("no", "h", "g")).alias("l")).select("k", "th", "l.*")
    firsts = scratch.table(each.groupBy("h", "g").agg(F.min(F.struct("k", "th", "no")).alias("first"), F.count(F.lit(1)).alias("n")), "firsts", release=True)
    near = near_lines(rows, firsts, firsts.count(), run, cell_lines).withColumn("near", F.lit(True))
    judged = scratch.table(firsts.join(near, ["h", "g"], "left").where("n > 1 OR near"), "judged", release=True)
    gone = each.join(judged, ["h", "g"]).where(F.coalesce("near", F.lit(False)) | (F.struct("k", "th", "no") != F.col("first")))
    # Rows that repeat doc_id and text are one document, whose lines the places above hold once for each row.
    return gone.groupBy("k", "th").agg(F.array_sort(F.collect_set("no")).alias("gone"))


def without_lines(parts: Column, gone: Column) -> Column:
    """The lines ``parts`` but for those numbered in the sorted array ``gone``, in one pass."""
    before, after = F.concat(F.array(F.lit(-1)), gone), F.concat(gone, F.array(F.size(parts)))
    return F.array_join(F.flatten(F.zip_with(before, after, lambda a, b: F.slice(parts, a + 2, b - a - 1))), "\n")


def strip_lines(docs: DataFrame, gone: DataFrame, keys: list[str], text_col: str, gone_col: str, parts_col: str) -> DataFrame:
    """``docs`` joined with ``gone`` (null where nothing goes), the text without its removed lines; ``parts_col`` is a free name."""
    # The lines are used twice, so that the optimiser keeps them as a column and splits a text once.
    rows = docs.join(gone, keys, "left").withColumn(parts_col, F.split(F.when(F.col(gone_col).isNotNull(), F.col(text_col)), "\n", -1))
    return rows.withColumn(text_col, F.when(F.col(gone_col).isNull(), F.col(text_col)).otherwise(without_lines(F.col(parts_col), F.col(gone_col)))).drop(parts_col)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, cell_lines: int = CELL_LINES) -> DataFrame:
    """One row per input row: doc_id, text without the removed lines (as it was if none is), n_removed."""
    out = strip_lines(keyed(docs, id_col, text_col), removed_lines(docs, id_col, text_col, run, cell_lines), ["k", "th"], "text", "gone", "parts")
    return out.select(F.when(F.col("k") != NO_ID, F.col("k")).alias("doc_id"), "text", F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"))
