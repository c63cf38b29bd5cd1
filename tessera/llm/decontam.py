"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Texts and test items are compared as words, with A-Z lower-cased and ASCII punctuation deleted.

1. Every ``SEED``-gram of an item is a seed.  All documents are scanned for seeds, and the document
   frequency of each is counted over the whole corpus.  A seed is *rare*, and used, if at most
   ``RARE`` of all documents hold it, or if it is at most ``USUAL`` times as frequent as the median
   seed of its item, or if no seed among the ``SPAN`` around it is rarer.  So common phrases are no
   seeds, but those of a passage that has been copied very widely are, and each stretch of
   SPAN + SEED - 1 copied words holds a used seed.
2. Hits of one item that lie close together in a document make a passage: the words around them, as
   wide as the item on either side.
3. A passage is aligned with the item by Smith-Waterman over words (match 1, mismatch -1/2, gap
   -1/2).  The score is the best local alignment over the item's length, so a verbatim copy scores 1
   and one with a tenth of its words replaced about 0.85.  A document is contaminated from
   ``CONTAMINATED``, or where the alignment itself counts ``LONG`` words, whatever their share of the
   item.

The test items are read in blocks of at most ``BLOCK_WORDS`` words, which is what is broadcast at once;
a larger benchmark takes more passes over the corpus.

4. An item of fewer than ``LEAST_WORDS`` words is one seed as a whole, so it is found verbatim only.  As
   a common phrase is no evidence, it counts where at most ``SHORT_RARE`` of all documents (one, if that
   is less) hold it.

Defined cases: a null text or item has no words and an item without words matches nothing; repeated
items count once each; a document that holds several items
is reported with the best score (ties: smallest item_id, null last); rows that repeat doc_id and text get
the same result; empty tables give empty or clean results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import scratch, ship, textkit
from tessera.llm.substring import NO_ID, keyed

SEED, SPAN, RARE, USUAL, CONTAMINATED, LEAST_WORDS = 3, 8, 0.001, 4, 0.5, 5
LONG, SHORT_RARE = 13, 0.01
BLOCK_WORDS = 1 << 20
MATCH, MISMATCH, GAP = 1.0, -0.5, 0.5
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[c for c in range(0x21, 0x7F) if not chr(c).isalnum()]] = True


def plain_words(raw: np.ndarray, offs: np.ndarray) -> textkit.Words:
    """Words without ASCII punctuation, lower-cased."""
    keep = ~_PUNCTUATION[raw]
    sums = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(keep, out=sums[1:])
    return textkit.Words(raw[keep], sums[offs], lower=True)


@dataclass
class Items:
    """Seeds and words of a block of test items."""

    ids: list[int | None]
    words: list[np.ndarray]  # word hashes of each item
    seeds: np.ndarray  # sorted distinct seed hashes
    first: np.ndarray  # places of seed s are first[s]:first[s + 1]
    item: np.ndarray  # item and offset of each place
    offset: np.ndarray
    sieve: np.ndarray  # low bits of the seeds, to skip most words cheaply
    short: dict[int, tuple[np.ndarray, np.ndarray]]  # by number of words: sorted hashes of whole short items and their seeds

    @classmethod
    def build(cls, ids: list[int | None], texts: list[str | None], size: int, least: int) -> Items:
        raw, offs = textkit.utf8(pa.array([t or "" for t in texts], pa.string()))
        words = plain_words(raw, offs)
        hashes = words.hashes()
        own = [hashes[a:b] for a, b in zip(words.first[:-1], words.first[1:])]
        seeds, item, offset = [], [], []
        brief: dict[int, dict[int, list[int]]] = {}
        for i, w in enumerate(own):
            if 0 < len(w) < max(size, least):
                brief.setdefault(len(w), {}).setdefault(int(textkit.ngrams(w, len(w))[0]), []).append(i)
            elif len(w):
                g = textkit.ngrams(w, size)
                seeds.append(g)
                item.append(np.full(len(g), i))
                offset.append(np.arange(len(g)))
        flat = np.concatenate(seeds) if seeds else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        names, counts = np.unique(flat, return_counts=True)
        sieve = np.zeros(1 << 20, bool)
        sieve[(names & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        join = lambda parts: np.concatenate(parts)[order] if parts else np.zeros(0, np.int64)
        short, items_of = {}, [join(item)]
        number, counts = len(names), counts.tolist()
        for n, found in sorted(brief.items()):
            short[n] = (np.array(sorted(found), np.uint64), np.arange(number, number + len(found)))
            number += len(found)
            counts += [len(found[g]) for g in sorted(found)]
            items_of += [np.array(found[g]) for g in sorted(found)]
        which = np.concatenate(items_of)
        return cls(ids, own, names, np.concatenate([[0], np.cumsum(counts, dtype=np.int64)]), which, np.concatenate([join(offset), np.zeros(len(which) - len(flat), np.int64)]), sieve, short)


def find_seeds(items: Items, words: textkit.Words, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Word positions where a seed begins, inside one text, and the seeds."""
    grams = textkit.ngrams(hashes, size)
    at = np.flatnonzero(items.sieve[(grams & np.uint64((1 << 20) - 1)).astype(np.int64)])
    found = [(at, *_look_up(items.seeds, grams[at]), size)]
    for n, (names, seeds) in items.short.items():
        spot, real = _look_up(names, textkit.ngrams(hashes, n))
        found.append((np.arange(len(spot)), seeds[spot] if len(seeds) else spot, real, n))
    places, numbers = [], []
    for at, spot, real, n in found:
        at, spot = at[real], spot[real]
        row = np.searchsorted(words.first, at, side="right") - 1
        inside = at + n <= words.first[row + 1]
        places.append(at[inside])
        numbers.append(spot[inside])
    return np.concatenate(places).astype(np.int64), np.concatenate(numbers).astype(np.int64)


def _look_up(names: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each gram among sorted names, and whether it is there."""
    if not len(names):
        return np.zeros(len(grams), np.int64), np.zeros(len(grams), bool)
    spot = np.minimum(np.searchsorted(names, grams), len(names) - 1)
    return spot, names[spot] == grams


def _passages(batches: Iterator[pa.RecordBatch], items: Items, size: int) -> Iterator[pa.RecordBatch]:
    """Passages around seeds: which seeds they hold and, for each word, its place in the item's sorted vocabulary (-1: elsewhere)."""
    vocab = [np.unique(w) for w in items.words]
    for batch in batches:
        out: list[tuple] = []
        ks, ths = batch.column("k"), batch.column("th")
        for a, _, raw, offs in textkit.blocks(batch.column("text")):
            words = plain_words(raw, offs)
            hashes = words.hashes()
            at, seed = find_seeds(items, words, hashes, size)
            if not len(at):
                continue
            n = items.first[seed + 1] - items.first[seed]
            place = np.repeat(items.first[seed] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            pos, which, seed = np.repeat(at, n), items.item[place], np.repeat(seed, n)
            row = np.searchsorted(words.first, pos, side="right") - 1
            order = np.lexsort((pos, which, row))
            pos, which, row, seed = pos[order], which[order], row[order], seed[order]
            length = np.array([len(w) for w in items.words])[which]
            new = np.concatenate([[True], (row[1:] != row[:-1]) | (which[1:] != which[:-1]) | (pos[1:] - pos[:-1] > length[1:])])
            cuts = np.concatenate([np.flatnonzero(new), [len(pos)]])
            for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                r, i, wide = int(row[s]), int(which[s]), int(length[s])
                low, high = max(int(words.first[r]), int(pos[s]) - wide), min(int(words.first[r + 1]), int(pos[e - 1]) + size + wide)
                mine = hashes[low:high]
                found = np.minimum(np.searchsorted(vocab[i], mine), len(vocab[i]) - 1)
                codes = np.where(vocab[i][found] == mine, found, -1).astype(np.int32)
                out.append((ks[a + r].as_py(), ths[a + r].as_py(), i, np.unique(seed[s:e]).tolist(), codes.tobytes(), low - int(words.first[r])))
        if out:
            cols = zip(*out)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.binary(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["k", "th", "item", "seeds", "codes", "start"])


def rare_seeds(items: Items, frequency: np.ndarray, documents: int, rare: float, span: int) -> np.ndarray:
    """Seeds to use: rare in the corpus, usual for their item, or the rarest of some stretch of ``span`` seeds of it; whole short items if rare."""
    used = frequency <= rare * documents
    used[len(items.seeds) :] = frequency[len(items.seeds) :] <= max(1, SHORT_RARE * documents)
    first = items.first[: len(items.seeds) + 1]
    seed = np.repeat(np.arange(len(items.seeds)), np.diff(first))
    item, offset = items.item[: first[-1]], items.offset[: first[-1]]
    order = np.lexsort((offset, item))
    item, seed = item[order], seed[order]
    for a, b in zip(*(lambda e: (e[:-1], e[1:]))(np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1], [True]])) if len(item) else np.zeros(0, int))):
        mine = seed[a:b]
        cost = frequency[mine]
        used[mine[cost <= USUAL * np.median(cost)]] = True
        for s in range(max(1, len(mine) - span + 1)):
            used[mine[s + int(np.argmin(cost[s : s + span]))]] = True
    return used


def align(item: np.ndarray, passages: list[np.ndarray]) -> list[tuple[float, int]]:
    """Best Smith-Waterman score of an item with each passage, and the passage word on which it ends.

    Passages advance together, one word of the item at a time; gaps along the passage are a running maximum.
    """
    width = max(len(p) for p in passages)
    codes = np.full((len(passages), width), -1, np.int32)
    for r, p in enumerate(passages):
        codes[r, : len(p)] = p
    slope = (GAP * np.arange(width)).astype(np.float32)
    row = np.zeros((len(passages), width), np.float32)
    best, end = np.zeros(len(passages), np.float32), np.zeros(len(passages), np.int64)
    for word in item:
        diagonal = np.zeros_like(row)
        diagonal[:, 1:] = row[:, :-1]
        now = np.maximum(np.maximum(diagonal + np.where(codes == word, np.float32(MATCH), np.float32(MISMATCH)), row - np.float32(GAP)), 0)
        row = np.maximum.accumulate(now + slope, axis=1) - slope
        top = row.argmax(axis=1)
        value = row[np.arange(len(row)), top]
        end = np.where(value > best, top, end)
        best = np.maximum(best, value)
    return list(zip(best.tolist(), end.tolist()))


def _align_all(batches: Iterator[pa.RecordBatch], items: Items, used: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Align the passages that hold a used seed."""
    sizes = np.array([len(w) for w in items.words])
    codes_of = [np.searchsorted(np.unique(w), w).astype(np.int32) for w in items.words]
    for batch in batches:
        if not batch.num_rows:
            continue
        seeds = batch.column("seeds")
        holds = np.add.reduceat(used[seeds.flatten().to_numpy()].astype(np.int64), seeds.offsets.to_numpy()[:-1] - seeds.offsets[0].as_py())  # no passage is without seeds
        batch = batch.filter(pa.array(holds > 0))
        item = batch.column("item").to_numpy()
        codes = [np.frombuffer(c, np.int32) for c in batch.column("codes").to_pylist()]
        score, aligned, end = np.zeros(len(item)), np.zeros(len(item)), np.zeros(len(item), np.int64)
        order = np.lexsort(([len(c) for c in codes], item))
        edges = np.flatnonzero(np.concatenate([[True], item[order][1:] != item[order][:-1], [True]])) if len(item) else [0]
        for a, b in zip(edges[:-1], edges[1:]):
            for s in range(a, b, 256):
                pick = order[s : min(b, s + 256)]
                i = item[pick[0]]
                for r, (value, last) in zip(pick, align(codes_of[i], [codes[r] for r in pick])):
                    score[r], aligned[r], end[r] = value / sizes[i], value, last
        start = batch.column("start").to_numpy()
        yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("th"), pa.array([items.ids[i] for i in item], pa.int64()), pa.array(np.round(score, 6)), pa.array((start + end + 1).astype(np.int32)), pa.array(aligned)], names=["k", "th", "item_id", "score", "ends", "aligned"])


def passages_found(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", rare: float = RARE, size: int = SEED, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Aligned passages: k, th, item_id, score, ends (the word after the passage's last one, in the document's plain words), aligned (the score in words)."""
    spark = docs.sparkSession
    ship.ensure(spark)
    rows = keyed(docs, id_col, text_col)
    n_docs = rows.count()
    parts: list[DataFrame] = []
    ids: list[int | None] = []
    texts: list[str | None] = []
    held = 0

    def search() -> None:
        items = Items.build(ids[:], texts[:], size, LEAST_WORDS)
        shared = spark.sparkContext.broadcast(items)
        hits = scratch.table(rows.mapInArrow(lambda it: _passages(it, shared.value, size), "k long, th long, item int, seeds array<int>, codes binary, start int"), "passages")
        # Bounded by the seeds of one block of items.
        counts = hits.select("k", "th", F.explode("seeds").alias("seed")).distinct().groupBy("seed").agg(F.count(F.lit(1)).alias("n")).toArrow()
        frequency = np.zeros(len(items.first) - 1, np.int64)
        frequency[counts.column("seed").to_numpy()] = counts.column("n").to_numpy()
        used = spark.sparkContext.broadcast(rare_seeds(items, frequency, n_docs, rare, SPAN))
        parts.append(hits.mapInArrow(lambda it: _align_all(it, shared.value, used.value), "k long, th long, item_id long, score double, ends int, aligned double"))

    for item in benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text).alias("text")).orderBy("item", "text").toLocalIterator():
        ids.append(item["item"])
        texts.append(item["text"])
        held += len((item["text"] or "").split())
        if held >= block_words:
            search()
            ids, texts, held = [], [], 0
    if ids:
        search()
    if not parts:
        return spark.createDataFrame([], "k long, th long, item_id long, score double, ends int, aligned double")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def contaminating(threshold: float = CONTAMINATED, long: float = LONG) -> Column:
    """Whether an aligned passage is too much of its item, or too long."""
    return (F.col("score") >= threshold) | (F.col("aligned") >= long)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = CONTAMINATED, **options) -> DataFrame:
    """One row per input row: doc_id, th, contaminated, best_item, best_score, n_items (items at or above the threshold, or with a long passage)."""
    found = passages_found(docs, benchmark, id_col, text_col, **options).where(F.col("score") > 0)
    by_item = found.groupBy("k", "th", "item_id").agg(F.max("score").alias("score"), F.max("aligned").alias("aligned"))
    rank = F.struct((-F.col("score")).alias("s"), F.col("item_id").isNull().alias("none"), F.col("item_id").alias("item"))
    by_doc = by_item.groupBy("k", "th").agg(F.min(rank).alias("best"), F.count_if(contaminating(threshold)).alias("n_items"))
    rows = keyed(docs, id_col, text_col).select("k", "th").join(by_doc, ["k", "th"], "left")
    score = F.coalesce(-F.col("best.s"), F.lit(0.0))
    return rows.select(F.when(F.col("k") != NO_ID, F.col("k")).alias("doc_id"), "th", ((score >= threshold) | (F.coalesce("n_items", F.lit(0)) > 0)).alias("contaminated"), F.col("best.item").alias("best_item"), score.alias("best_score"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"))
