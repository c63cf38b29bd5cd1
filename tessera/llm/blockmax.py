"""Ranked lexical search over block-max indexes, Block-Max WAND on whole arrays.

Terms are maximal runs of ASCII letters and digits and of characters above U+007F; only A-Z is
lower-cased.  With N documents that have terms, L terms in all of them, n terms in a document, df
documents that hold a term and tf of its occurrences in the document, all integers and div rounding down:

    weight w = floor(1000 * ln((2 N + 2) / (2 df + 1)))        m = 10 + (90 n N) div L
    impact   = (1000000000 tf) div (1000 tf + 8 m)             score = sum of w * impact

1. *Index.*  Documents are cut into shards of about ``SHARD_BYTES`` of text, numbered inside by rising
   doc_id.  A shard holds a posting list for each of its terms: blocks of ``BLOCK`` postings, bit-packed
   (gaps and term counts, each with the width that the block needs), and beside them, uncompressed, the
   last document and the largest impact of each block.  Postings are never shuffled to build it.
2. *Shallow moves.*  For a query in a shard the edges of its lists' blocks divide the documents into
   segments; inside one, every list's pointer stands on one block.  The sum of weight times largest impact
   of those blocks bounds every score in the segment.  All these bounds are made by one sort and a running
   sum over the block heads, without reading a posting.
3. *Deep moves.*  Segments are taken in order of falling bounds, in rounds that grow; only blocks that
   reach into them are decompressed.  As soon as the bounds of what is left are below the k-th best score,
   the rest is skipped.  A bound equal to it is not, since equal scores are ranked by doc_id.
4. *Thresholds.*  The first shard of every ``SEED_EVERY``-th partition is searched first.  The k-th best score
   found there is a lower bound for the whole table, so the other shards return only what can still count:
   about k * shards / first shards rows for a query, however large the corpus.

Queries go to the shards in blocks of about ``BLOCK_PAIRS`` (query, term) pairs, so neither is collected: the
posting lists of a block's terms meet in the task of (shard, block).

Defined cases: a null text has no terms; queries without terms, or only with terms that no document holds
or whose weight is 0, have no result; rows that share an item_id are one query with the terms of all; a
null item_id is a query like others; rows that share a doc_id are documents of their own and may both be
listed; a null doc_id ranks behind equal scores; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm import scratch, ship, textkit

BLOCK = 128
SHARD_BYTES = 16 << 20
SEED_EVERY = 16
BLOCK_PAIRS = 1 << 18
FIRST_SEGMENTS, GROWTH = 8, 4
NO_ID = (1 << 63) - 1

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_TERM = np.zeros(256, bool)
_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

INDEX = "shard long, seed boolean, term binary, n int, last binary, top binary, widths binary, data binary"


def terms_of(raw: np.ndarray, offs: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The terms of texts, lower-cased, and how many each text has."""
    ink = _TERM[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offs] = True
    begins = ink.copy()
    begins[1:] &= ~ink[:-1] | edge[1:-1]
    start = np.flatnonzero(begins)
    data = _LOWER[raw[ink]]
    inked = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(ink, out=inked[1:])
    places = np.append(inked[start], len(data))
    counts = np.diff(np.searchsorted(start, offs))
    return pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(places), pa.py_buffer(data)]), counts


def _spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one range after the other."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def _bits(x: np.ndarray) -> np.ndarray:
    """Bits that a number needs, 0 for 0."""
    return np.frexp(x.astype(np.float64))[1].astype(np.int64)


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, total: int) -> np.ndarray:
    tf, n = tf.astype(np.int64), n.astype(np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 8 * (10 + (90 * n * documents) // max(total, 1)))


def pack(doc: np.ndarray, tf: np.ndarray, impact: np.ndarray, first: np.ndarray, block: int) -> dict[str, np.ndarray]:
    """Posting lists, one after the other, in blocks: ``first`` has where each begins.

    Returns for each block size, last document, largest impact, widths and first byte, for each list its first block,
    and the packed bytes.
    """
    count = np.diff(np.append(first, len(doc)))
    inside = np.arange(len(doc)) - np.repeat(first, count)
    begin = np.flatnonzero(inside % block == 0)
    size = np.diff(np.append(begin, len(doc)))
    before = np.append(-1, doc[:-1])
    before[first] = -1
    gap, more = doc - before - 1, tf.astype(np.int64) - 1
    widths = [_bits(np.maximum.reduceat(x, begin)) for x in (gap, more)]
    place = np.append(0, np.cumsum((size * (widths[0] + widths[1]) + 7) // 8))
    bits = np.zeros(int(place[-1]) * 8, np.uint8)
    nth = np.arange(len(doc)) - np.repeat(begin, size)
    start = np.repeat(place[:-1] * 8, size)
    for x, width, shift in ((gap, widths[0], np.zeros(len(size), np.int64)), (more, widths[1], size * widths[0])):
        wide = np.repeat(width, size)
        at = start + np.repeat(shift, size) + nth * wide
        for k in range(int(width.max(initial=0))):
            some = np.flatnonzero((x >> k & 1) & (wide > k))
            bits[at[some] + k] = 1
    return {
        "size": size, "last": doc[begin + size - 1].astype(np.int32), "top": np.maximum.reduceat(impact, begin).astype(np.int32),
        "widths": np.stack(widths, axis=1).astype(np.uint8), "place": place, "first_block": np.searchsorted(begin, first), "data": np.packbits(bits, bitorder="little"),
    }


def _binary(data: np.ndarray, edges: np.ndarray) -> pa.Array:
    """A binary column from its bytes and where each row begins, and the end."""
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def index_shard(number: int, seed: bool, ids: np.ndarray, raw: np.ndarray, offs: np.ndarray, documents: int, total: int, block: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """Rows of one shard: a list for each term and, with a null term, the doc_ids (last) and lengths (top) of its documents."""
    terms, n = terms_of(raw, offs)
    order = np.argsort(ids, kind="stable")
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.arange(len(ids))
    encoded = terms.dictionary_encode()
    key, tf = np.unique(encoded.indices.to_numpy().astype(np.int64) << 32 | np.repeat(rank, n), return_counts=True)
    if not len(key):
        return
    doc, term = key & 0xFFFFFFFF, key >> 32
    first = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
    lists = pack(doc, tf, impacts(tf, n[order][doc], documents, total), first, block)
    blocks = np.append(lists["first_block"], len(lists["size"]))
    counts = np.diff(np.append(first, len(doc)))
    names = [f.strip().split()[0] for f in INDEX.split(",")]
    one = lambda x: pa.array([x], pa.binary())
    head = [pa.array([number], pa.int64()), pa.array([seed]), one(None), pa.array([len(ids)], pa.int32()), one(ids[order].tobytes()), one(n[order].astype(np.int32).tobytes()), one(b""), one(b"")]
    yield pa.RecordBatch.from_arrays(head, names=names)
    columns = [
        pa.array(np.full(len(first), number)), pa.array(np.full(len(first), seed)), encoded.dictionary.cast(pa.binary()), pa.array(counts.astype(np.int32)),
        _binary(lists["last"].view(np.uint8), blocks * 4), _binary(lists["top"].view(np.uint8), blocks * 4), _binary(lists["widths"].reshape(-1), blocks * 2), _binary(lists["data"], lists["place"][blocks]),
    ]
    yield pa.RecordBatch.from_arrays(columns, names=names)


@dataclass(frozen=True)
class Index:
    """Index rows in the shared folder, and the numbers of documents with terms and of all their terms."""

    rows: DataFrame
    documents: int
    total: int


def _ids_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("k"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES, block: int = BLOCK) -> Index:
    """Index all documents; texts are read twice, once for N and L."""
    ship.ensure(docs.sparkSession)
    rows = _ids_and_text(docs, id_col, text_col)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = total = 0
        for batch in batches:
            for _, _, raw, offs in textkit.blocks(batch.column("text")):
                counts = terms_of(raw, offs)[1]
                n, total = n + int((counts > 0).sum()), total + int(counts.sum())
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total])], names=["n", "total"])

    size = rows.select("text").mapInArrow(count, "n long, total long").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).first()
    documents, total = size["n"] or 0, size["total"] or 0

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal made
            ids, raw = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            offs = np.append(0, np.cumsum(np.concatenate([np.diff(h[2]) for h in held])))
            held.clear()
            yield from index_shard(part << 32 | made, made == 0 and part % SEED_EVERY == 0, ids, raw, offs, documents, total, block)
            made += 1

        for batch in batches:
            ids = batch.column("k").to_numpy()
            for a, b, raw, offs in textkit.blocks(batch.column("text"), min(shard_bytes, textkit.BLOCK_BYTES)):
                held.append((ids[a:b], raw.copy(), offs))
                if sum(len(h[1]) for h in held) >= shard_bytes:
                    yield from flush()
        if held:
            yield from flush()

    return Index(scratch.table(rows.mapInArrow(index, INDEX), "index"), documents, total)


class Shard:
    """The lists of a block of queries in one shard; blocks are decompressed when a score needs them, and once."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, counts: np.ndarray, last: np.ndarray, top: np.ndarray, widths: np.ndarray, data: np.ndarray, places: np.ndarray, documents: int, total: int, block: int = BLOCK):
        """``places`` has the first byte of each list's data."""
        self.ids, self.n, self.documents, self.total = ids, n, documents, total
        self.blocks_of = -(-counts // block)
        self.first_block = np.cumsum(self.blocks_of) - self.blocks_of
        owner = np.repeat(np.arange(len(counts)), self.blocks_of)
        nth = np.arange(len(owner)) - self.first_block[owner]
        self.size = np.minimum(block, counts[owner] - nth * block)
        self.last, self.top, self.widths = last.astype(np.int64), top.astype(np.int64), widths.astype(np.int64).reshape(-1, 2)
        self.before = np.append(-1, self.last[:-1])
        self.before[self.first_block] = -1
        length = (self.size * self.widths.sum(axis=1) + 7) // 8
        upto = np.cumsum(length) - length
        self.byte = upto - upto[self.first_block][owner] + places[owner]
        self.post = np.cumsum(self.size) - self.size
        self.doc, self.impact = np.empty(int(self.size.sum()), np.int32), np.empty(int(self.size.sum()), np.int32)
        self.open = np.zeros(len(owner), bool)
        self.eights = np.ndarray((len(data) + 1,), "<u8", np.append(data, np.zeros(8, np.uint8)), strides=(1,))

    def _numbers(self, bit: np.ndarray, width: np.ndarray) -> np.ndarray:
        """Numbers of up to 57 bits at any bit of the data."""
        return (self.eights[bit >> 3] >> (bit & 7).astype(np.uint64) & ((np.uint64(1) << width.astype(np.uint64)) - np.uint64(1))).astype(np.int64)

    def decompress(self, blocks: np.ndarray) -> None:
        blocks = blocks[~self.open[blocks]]
        if not len(blocks):
            return
        size, (gaps, tfs) = self.size[blocks], self.widths[blocks].T
        first = np.cumsum(size) - size
        nth = np.arange(int(size.sum())) - np.repeat(first, size)
        start = np.repeat(self.byte[blocks] * 8, size)
        gap = self._numbers(start + nth * np.repeat(gaps, size), np.repeat(gaps, size))
        tf = self._numbers(start + np.repeat(size * gaps, size) + nth * np.repeat(tfs, size), np.repeat(tfs, size)) + 1
        steps = np.cumsum(gap + 1)
        doc = steps - np.repeat(steps[first] - gap[first] - 1 - self.before[blocks], size)
        at = _spans(self.post[blocks], size)
        self.doc[at], self.impact[at] = doc, impacts(tf, self.n[doc], self.documents, self.total)
        self.open[blocks] = True

    def search(self, lists: np.ndarray, weights: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """doc_ids and scores of the k best documents with at least the score ``least`` (1 or more), best first."""
        blocks = _spans(self.first_block[lists], self.blocks_of[lists])
        weight = np.repeat(weights, self.blocks_of[lists])
        bound = weight * self.top[blocks]
        edges, at = np.unique(np.concatenate([self.before[blocks] + 1, self.last[blocks] + 1]), return_inverse=True)
        begin, end = at[: len(blocks)], at[len(blocks) :]
        change = np.zeros(len(edges), np.int64)
        np.add.at(change, begin, bound)
        np.subtract.at(change, end, bound)
        bounds = np.cumsum(change)[:-1]
        order = np.argsort(-bounds, kind="stable")
        docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        done, step = 0, FIRST_SEGMENTS
        while done < len(order) and bounds[order[done]] >= least:
            taken = order[done : done + step]
            chosen = np.zeros(len(bounds), bool)
            chosen[taken[bounds[taken] >= least]] = True
            upto = np.append(0, np.cumsum(chosen))
            need = upto[end] > upto[begin]
            self.decompress(blocks[need])
            size = self.size[blocks[need]]
            posts = _spans(self.post[blocks[need]], size)
            doc = self.doc[posts]
            inside = np.repeat(chosen, np.diff(edges))[doc - edges[0]]
            total = np.zeros(int(edges[-1] - edges[0]), np.int64)
            np.add.at(total, doc[inside] - edges[0], (np.repeat(weight[need], size) * self.impact[posts])[inside])
            new = np.flatnonzero(total >= least)
            docs, scores = np.append(docs, new + edges[0]), np.append(scores, total[new])
            best = np.lexsort((docs, -scores))[:k]
            docs, scores = docs[best], scores[best]
            if len(docs) == k:
                least = max(least, int(scores[-1]))
            done, step = done + step, step * GROWTH
        return self.ids[docs], scores


def _joined(column: pa.ChunkedArray, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def search_shard(table: pa.Table, documents: int, total: int, k: int, block: int) -> pa.Table:
    """Answer the queries whose terms meet in a shard: the row with a null term has its documents, the others lists and who asks for them."""
    heads = pc.is_null(table.column("term"))
    head, lists = table.filter(heads), table.filter(pc.invert(heads))
    out: list[tuple[int, np.ndarray, np.ndarray]] = []
    if len(lists):
        data = lists.column("data").to_pylist()
        places = np.cumsum([0] + [len(d) for d in data])[:-1]
        shard = Shard(
            np.frombuffer(head.column("last")[0].as_py(), np.int64), np.frombuffer(head.column("top")[0].as_py(), np.int32), lists.column("n").to_numpy().astype(np.int64),
            _joined(lists.column("last"), np.int32), _joined(lists.column("top"), np.int32), _joined(lists.column("widths"), np.uint8), np.frombuffer(b"".join(data), np.uint8), places, documents, total, block,
        )
        asks = lists.column("asks").combine_chunks()
        asked = asks.flatten()
        row = np.repeat(np.arange(len(lists)), np.diff(asks.offsets.to_numpy()))
        item, least = asked.field("item").to_numpy(), asked.field("least").to_numpy()
        weight = lists.column("w").to_numpy()
        order = np.argsort(item, kind="stable")
        cuts = np.flatnonzero(np.append(True, item[order][1:] != item[order][:-1]))
        for mine in np.split(order, cuts[1:]):
            found, scores = shard.search(row[mine], weight[row[mine]], k, int(least[mine[0]]))
            out.append((int(item[mine[0]]), found, scores))
    names = np.repeat(np.array([o[0] for o in out], np.int64), [len(o[1]) for o in out])
    flat = lambda i: np.concatenate([o[i] for o in out]) if out else np.zeros(0, np.int64)
    return pa.table({"item": pa.array(names, pa.int64()), "k": pa.array(flat(1), pa.int64()), "score": pa.array(flat(2), pa.int64())})


def query_terms(queries: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item, term: distinct."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, raw, offs in textkit.blocks(batch.column("text")):
                terms, counts = terms_of(raw, offs)
                yield pa.RecordBatch.from_arrays([batch.column("k").slice(a, b - a).take(pa.array(np.repeat(np.arange(b - a), counts))), terms.cast(pa.binary())], names=["item", "term"])

    return _ids_and_text(queries, item_col, text_col).mapInArrow(cut, "item long, term binary").distinct()


def search(index: Index, queries: DataFrame, k: int = 10, item_col: str = "item_id", text_col: str = "text", block_pairs: int = BLOCK_PAIRS, block: int = BLOCK) -> DataFrame:
    """item_id, rank, doc_id, score of the k best documents of each query; ``block`` as the index was built."""
    ship.ensure(queries.sparkSession)
    documents, total = index.documents, index.total
    asked = scratch.table(query_terms(queries, item_col, text_col), "query-terms")
    held = index.rows.where("term IS NOT NULL").join(asked.select("term").distinct(), "term").groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * documents + 2) / (2 * F.col("df") + 1).cast("double"))).cast("long")
    asked = scratch.table(asked.join(held.select("term", weight.alias("w")).where("w > 0"), "term"), "query-weights")
    parts = max(1, -(-asked.count() // block_pairs))
    asked = asked.withColumn("part", F.pmod(F.xxhash64("item"), F.lit(parts)).cast("int"))

    def run(rows: DataFrame, asked: DataFrame, name: str) -> DataFrame:
        asks = scratch.table(asked.groupBy("part", "term").agg(F.first("w").alias("w"), F.collect_list(F.struct("item", "least")).alias("asks")), "query-asks")
        keep = ("shard", "term", "n", "last", "top", "widths", "data")
        lists = rows.where("term IS NOT NULL").select(*keep).join(asks, "term").select(*keep, "part", "w", "asks")
        none = F.array().cast("array<struct<item: bigint, least: bigint>>")
        heads = rows.where("term IS NULL").select(*keep, F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(0).cast("long").alias("w"), none.alias("asks"))
        found = lists.unionByName(heads).groupBy("shard", "part").applyInArrow(lambda table: search_shard(table, documents, total, k, block), "item long, k long, score long")
        return scratch.table(found, name)

    best = Window.partitionBy("item").orderBy(F.desc("score"), "k")
    first = run(index.rows.where("seed"), asked.withColumn("least", F.lit(1).cast("long")), "found-first")
    least = first.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k).select("item", F.col("score").alias("least"))
    rest = run(index.rows.where("NOT seed"), asked.join(scratch.table(least, "thresholds"), "item", "left").withColumn("least", F.coalesce("least", F.lit(1).cast("long"))), "found-rest")
    ranked = first.unionByName(rest).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    back = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return ranked.select(back("item").alias("item_id"), F.col("rank").cast("int").alias("rank"), back("k").alias("doc_id"), "score")


def ranked_search(docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Index the documents and rank them for every query."""
    return search(build_index(docs, id_col, text_col, shard_bytes), queries, k, item_col, item_text)
