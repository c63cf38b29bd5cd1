"""Substring deduplication with a compressed FM-index for each shard.

A window is ``WINDOW`` consecutive words (``[^\\x20\\x09-\\x0D]+``, unchanged) of one document.  A
word is removed if a window that covers it also starts earlier: in a smaller doc_id, or earlier in
the same document.  Windows are judged on the input, not on what is left of it.

Equal windows have the same minimiser (the smallest hash among their 5-grams), so runs of windows
with one occurrence of a minimiser, *segments*, are the unit of work:

1. Minimisers are counted over the corpus; a segment whose minimiser occurs once holds no repeated
   window and is done.
2. The other segments go to the shard that owns their minimiser.  Identical segments are merged
   before the shuffle, keeping their first place, so copies of a text cost one segment.  Segments of
   very frequent minimisers are cut into single windows owned by their own hash, which spreads what
   surrounds a widely shared passage over all shards.
3. A shard indexes its segments (Burrows-Wheeler transform in a wavelet matrix) and streams the
   documents' segments through backward search, whose matching statistics, cut at the window length,
   give the interval of each window; of the windows of an interval the earliest stays.
4. A segment that is not the first of its kind is repeated as a whole.

Defined cases: a null text has no words; a null doc_id ranks behind every other; rows that repeat
both doc_id and text are one document for this purpose and get the same result; rows that share a
doc_id with other texts are told apart by a hash of the text and ranked by it; empty tables give
empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import scratch, ship, textkit
from tessera.llm.fmindex import FMIndex

WINDOW = 20
#: Words of the n-grams whose smallest hash routes a window, so a minimiser covers WINDOW - GRAM + 1 = 16 n-grams.
GRAM = 5
#: Occurrences above which the segments of a minimiser are cut into single windows.
HOT = 5000
#: Words that one index holds, if no single minimiser has more; segments merged before they are passed on.
SHARD_WORDS = 600_000
MERGE_SEGMENTS = 100_000

NO_ID = (1 << 63) - 1


def key_of(id_col: str) -> Column:
    """The id, or the largest long for null."""
    return F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Key of a document (k, th) and its text."""
    return docs.select(key_of(id_col).alias("k"), F.xxhash64(text_col).alias("th"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def segments_of(first: np.ndarray, hashes: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with the same occurrence of a minimiser: minimiser, first word in the row, windows, segments of each row.

    A run has at most window - gram + 1 windows.  Equal windows never share an occurrence, so two of
    them always give their minimiser two segments.
    """
    reach = window - gram + 1
    low = textkit.ngrams(hashes, gram)
    place = np.arange(len(low))  # of the leftmost smallest
    size = 1
    while size < reach:
        by = min(size, reach - size)
        m = max(len(low) - by, 0)
        right = low[by:] < low[:m]
        place = np.where(right, place[by:], place[:m])
        low = np.where(right, low[by:], low[:m])
        size += by
    at, counts = textkit.windows(first, window)
    if not len(at):
        return low[:0], at, at, counts
    low, place = low[at], place[at]
    row = np.repeat(np.arange(len(counts)), counts)
    cut = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (row[1:] != row[:-1])]))
    sizes = np.diff(np.concatenate([cut, [len(low)]]))
    return low[cut], at[cut] - first[:-1][row[cut]], sizes, np.bincount(row[cut], minlength=len(counts))


def _cut(batches: Iterator[pa.RecordBatch], window: int, gram: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, raw, offs in textkit.blocks(batch.column("text")):
            words = textkit.Words(raw, offs)
            low, start, sizes, counts = segments_of(words.first, words.hashes(), window, gram)
            has = counts > 0
            rows = batch.slice(a, b - a).filter(pa.array(has))
            yield pa.RecordBatch.from_arrays(
                [rows.column("k"), rows.column("th"), textkit.ragged(low.view(np.int64), counts[has], pa.int64()), textkit.ragged(start.astype(np.int32), counts[has], pa.int32()), textkit.ragged(sizes.astype(np.int32), counts[has], pa.int32())],
                names=["k", "th", "low", "start", "windows"],
            )


def _pieces(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Word sequences of marked segments; of identical ones in this task, up to a bound, only the first in order."""
    merged: dict[tuple[int | None, bytes], tuple[int, int, int, int]] = {}

    def drain() -> pa.RecordBatch:
        keys, rest = list(merged), list(merged.values())
        cols = [pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.binary())]
        cols += [pa.array([r[i] for r in rest], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32()))]
        merged.clear()
        return pa.RecordBatch.from_arrays(cols, names=["route", "piece", "k", "th", "start", "windows"])

    def add(route: int | None, piece: bytes, place: tuple[int, int, int, int]) -> None:
        held = merged.get((route, piece))
        if held is None or place < held:
            merged[route, piece] = place

    for batch in batches:
        for k, th, text, marks in zip(*(batch.column(c).to_pylist() for c in ("k", "th", "text", "marks"))):
            words = text.split()
            for mark in marks:
                start, n, low = mark["start"], mark["windows"], mark["low"]
                if mark["hot"]:
                    for s in range(start, start + n):
                        piece = b" ".join(words[s : s + window])
                        add(None, piece, (k, th, s, 1))
                else:
                    add(low, b" ".join(words[start : start + n + window - 1]), (k, th, start, n))
            if len(merged) >= MERGE_SEGMENTS:
                yield drain()
    if merged:
        yield drain()


def _shard(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Index and stream whole owners (sorted by owner), a bounded number of words at a time."""
    held: list[pa.RecordBatch] = []
    words = 0

    def size(rows: pa.RecordBatch) -> int:
        return int(rows.column("windows").to_numpy().sum()) + (window - 1) * rows.num_rows

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        words += size(batch)
        if words >= SHARD_WORDS:
            rows = pa.Table.from_batches(held)
            owner = rows.column("owner").to_numpy()
            cut = int(np.searchsorted(owner, owner[-1]))  # the last owner may go on in the next batch
            if cut:
                yield _search(rows.slice(0, cut), window)
                held = rows.slice(cut).to_batches()
                words = sum(map(size, held))
    if held:
        yield _search(pa.Table.from_batches(held), window)


def _search(rows: pa.Table, window: int) -> pa.RecordBatch:
    """Windows of each distinct segment that start earlier elsewhere, as the bits of ``mask``."""
    order: dict[tuple[int, bytes], int] = {}
    cols = [rows.column(c).to_pylist() for c in ("owner", "piece", "k", "th", "start", "windows")]
    best: list[tuple[int, int, int, int]] = []
    pieces: list[bytes] = []
    for owner, piece, *place in zip(*cols):
        at = order.setdefault((owner, piece), len(best))
        if at == len(best):
            best.append(tuple(place))
            pieces.append(piece)
        elif tuple(place) < best[at]:
            best[at] = tuple(place)
    k, th, start, count = (np.array(c, dtype=np.int64) for c in zip(*best))
    raw, offs = textkit.utf8(pa.array(pieces, pa.binary()))
    words = textkit.Words(raw, offs)
    names, ids = np.unique(words.hashes(), return_inverse=True)
    n = len(pieces)
    text = np.zeros(len(ids) + n, np.int64)
    row = words.row_of()
    text[np.arange(len(ids)) + row] = ids + 1
    index = FMIndex(text, len(names) + 1, window)
    del text
    lengths, lows, _ = index.matching_statistics(ids + 1, words.first)
    seg = np.repeat(np.arange(n), count)
    offset = np.arange(len(seg)) - np.repeat(np.cumsum(count) - count, count)
    places = words.first[:-1][seg] + offset
    if (lengths[places] < window).any():
        raise AssertionError("a window of an indexed segment was not found")
    groups = np.unique(lows[places], return_inverse=True)[1]  # an interval of whole windows is known by where it begins
    many = np.flatnonzero(np.bincount(groups)[groups] > 1)
    by = many[np.lexsort(((start[seg] + offset)[many], th[seg[many]], k[seg[many]], groups[many]))]
    again = np.zeros(len(groups), bool)
    if len(by):
        again[by[1:]] = groups[by[1:]] == groups[by[:-1]]
    mask = np.add.reduceat(again.astype(np.int64) << offset, np.cumsum(count) - count)
    return pa.RecordBatch.from_arrays([pa.array(k), pa.array(th), pa.array(start, pa.int32()), pa.array(count, pa.int32()), pa.array(mask)], names=["k", "th", "start", "windows", "mask"])


def _strip(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Take the covered words out of each text."""
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        n_words, n_removed, kept, removed = [], [], [], []
        for text, marks in zip(batch.column("text").to_pylist(), batch.column("marks").to_pylist()):
            words = text.split()
            n_words.append(len(words))
            drop = None
            if marks:
                again = np.zeros(len(words) + 1, bool)
                for m in marks:
                    if m["mask"] < 0:
                        again[m["start"] : m["start"] + m["windows"]] = True
                for m in marks:
                    if m["mask"] >= 0:
                        again[m["start"] : m["start"] + m["windows"]] = [(m["mask"] >> i) & 1 for i in range(m["windows"])]
                at = np.flatnonzero(again)
                if len(at):
                    edges = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edges, at, 1)
                    np.add.at(edges, at + window, -1)
                    drop = np.cumsum(edges[:-1]) > 0
            if drop is None:
                n_removed.append(0)
                removed.append([])
                kept.append(b" ".join(words))
            else:
                n_removed.append(int(drop.sum()))
                step = np.flatnonzero(np.diff(np.concatenate([[0], drop.astype(np.int8), [0]])))
                removed.append([{"start": int(a), "end": int(b)} for a, b in step.reshape(-1, 2)])
                kept.append(b" ".join(compress(words, ~drop)))
        yield pa.RecordBatch.from_arrays(
            [batch.column("k"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(removed, spans)],
            names=["k", "n_words", "n_removed", "kept_text", "removed_spans"],
        )


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, hot: int = HOT) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_text (kept words joined by a space), removed_spans (word ranges, end exclusive)."""
    ship.ensure(docs.sparkSession)
    if window < GRAM or window > 30:
        raise ValueError(f"window must be between {GRAM} and 30 words")
    rows = keyed(docs, id_col, text_col)
    cut = scratch.table(rows.mapInArrow(lambda it: _cut(it, window, GRAM), "k long, th long, low array<long>, start array<int>, windows array<int>"), "segments")
    # Written out, so that adaptive execution can split the join of a frequent minimiser.
    counts = cut.select(F.explode("low").alias("low")).groupBy("low").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("low", (F.col("n") > hot).alias("hot"))
    counts = scratch.table(counts, "minimisers", release=True)
    each = cut.select("k", "th", F.explode(F.arrays_zip("low", "start", "windows")).alias("s")).select("k", "th", "s.*")
    repeated = each.join(counts, "low")
    marked = scratch.table(repeated.groupBy("k", "th").agg(F.collect_list(F.struct("start", "windows", "low", "hot")).alias("marks")), "repeated", release=True)

    texts = rows.withColumn("text", F.encode("text", "UTF-8"))
    pieces = texts.join(marked, ["k", "th"]).mapInArrow(lambda it: _pieces(it, window), "route long, piece binary, k long, th long, start int, windows int")
    owned = pieces.withColumn("owner", F.coalesce("route", F.xxhash64("piece")))
    owned = owned.repartition("owner").sortWithinPartitions("owner")
    first = owned.mapInArrow(lambda it: _shard(it, window), "k long, th long, start int, windows int, mask long")
    default = marked.select("k", "th", F.explode("marks").alias("m")).select("k", "th", "m.start", "m.windows", F.lit(-1).cast("long").alias("mask"))
    marks = first.unionByName(default).groupBy("k", "th").agg(F.collect_list(F.struct("start", "windows", "mask")).alias("marks"))
    out = texts.join(marks, ["k", "th"], "left").mapInArrow(lambda it: _strip(it, window), "k long, n_words long, n_removed long, kept_text string, removed_spans array<struct<start:int,end:int>>")
    return out.select(F.when(F.col("k") != NO_ID, F.col("k")).alias("doc_id"), "n_words", "n_removed", "kept_text", "removed_spans")
