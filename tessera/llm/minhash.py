"""MinHash near-deduplication with an LSH forest.

Two documents are linked when the Jaccard similarity of their sets of distinct word shingles (A-Z
lower-cased) is at least ``percent`` / 100; the result gives connected components of links.

1. Documents with equal sets form a class; from here on a class is one item, known by its smallest
   doc_id.  Copies are merged by map-side aggregation.
2. LSH forest: the MinHash signature of a class is read in ``TREES`` orders of ``DEPTH`` values.  For
   each order the classes are sorted globally by their values.  Candidates of a class are the next
   ``NEIGHBOURS`` in the order that share a prefix.  How long a prefix depends on the region: at
   least ``FLOOR`` values, and more where so many classes share it that it says little; the direct
   neighbour always counts from ``FLOOR``.  Candidates whose signature estimate is far below the
   threshold are dropped.
3. Components of candidates are *clusters*; they are wider than what is sought.  Within a cluster the
   full sets are compared through posting lists, which finds every link, however many members share
   a region, up to what connects them: a hub is compared with all, and all that the hub does not
   reach are compared with all.  A cluster above ``CELL`` members or ``CELL_SHINGLES`` shingles is cut
   into blocks, every pair of which is a task of its own, so no task holds more than two blocks.

Defined cases: a null text has no words; without words a row has the empty set and is linked with
nothing; with fewer words than a shingle has, the whole sequence is its only shingle; rows that share
a doc_id are one node; a null doc_id takes part by its text and gives null where it would be named;
empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import graph, scratch, ship, textkit

TREES, DEPTH, FLOOR, NEIGHBOURS = 16, 6, 3, 8
#: Estimated similarity from which candidates count, for a threshold of 80 percent: more than four standard errors below it.
SLACK = 0.18
#: Members of a cluster that one block of an exact comparison holds.
CELL = 4000
#: Shingles that it holds (8 bytes each): long texts make smaller blocks.
CELL_SHINGLES = 4_000_000
#: Keys of rows without a doc_id lie above this.
NULL_KEYS = (1 << 63) - 1 - (1 << 40)
_PERMUTATIONS = np.random.default_rng(20240).integers(1, 1 << 32, size=(2, TREES * DEPTH), dtype=np.uint64).astype(np.uint32)
_MULTIPLY, _FLIP = _PERMUTATIONS[0] | np.uint32(1), _PERMUTATIONS[1]
#: Nibbles that are zero in a byte.
_ZEROS = np.array([(b < 16) + (b % 16 == 0) for b in range(256)], np.uint8)


def key_of(id_col: str, text_col: str) -> Column:
    """The id, or for null a number above all ids that the text decides."""
    return F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_KEYS + 1) + F.pmod(F.xxhash64(text_col), F.lit((1 << 40) - 2)))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Node key, hash of the text, text."""
    return docs.select(key_of(id_col, text_col).alias("k"), F.xxhash64(text_col).alias("th"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def visible(key: Column) -> Column:
    """A key as a doc_id: null for rows that have none."""
    return F.when(key <= NULL_KEYS, key)


def shingle_sets(raw: np.ndarray, offs: np.ndarray, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words = textkit.Words(raw, offs, lower=True)
    hashes = words.hashes()
    grams = textkit.ngrams(hashes, size)
    sets = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if b - a >= size:
            sets.append(np.unique(grams[a : b - size + 1]))
        elif b > a:
            sets.append(textkit.ngrams(hashes[a:b], b - a) ^ np.uint64(b - a))
        else:
            sets.append(grams[:0])
    return sets


def signatures(flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """MinHash values (rows, TREES * DEPTH) of non-empty sets given one after the other."""
    low = (flat >> np.uint64(32)).astype(np.uint32)
    at = np.cumsum(counts) - counts
    out = np.empty((len(counts), TREES * DEPTH), np.uint32)
    for i in range(TREES * DEPTH):
        out[:, i] = np.minimum.reduceat((low ^ _FLIP[i]) * _MULTIPLY[i], at)
    return out


def _sign(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, raw, offs in textkit.blocks(batch.column("text")):
            sets = shingle_sets(raw, offs, size)
            counts = np.array([len(s) for s in sets], np.int64)
            has = np.flatnonzero(counts)
            h1, h2, sigs = np.zeros(b - a, np.int64), np.zeros(b - a, np.int64), np.full(b - a, b"", object)
            if len(has):
                flat = np.concatenate([sets[i] for i in has])
                at = np.cumsum(counts[has]) - counts[has]
                h1[has] = np.add.reduceat(textkit.mix(flat), at).view(np.int64)
                h2[has] = np.add.reduceat(textkit.mix(flat ^ np.uint64(0xA5A5A5A5A5A5A5A5)), at).view(np.int64)
                sigs[has] = [row.tobytes() for row in signatures(flat, counts[has])]
            part = batch.slice(a, b - a)
            yield pa.RecordBatch.from_arrays([part.column("k"), part.column("th"), pa.array(counts), pa.array(h1), pa.array(h2), pa.array(list(sigs), pa.binary())], names=["k", "th", "n", "h1", "h2", "sig"])


def _plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each class and tree: sort key (values, most significant byte first) and 4-bit sketch of the whole signature."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(n, TREES * DEPTH)
        nibbles = (sig & 15).astype(np.uint8)
        sketch = (nibbles[:, ::2] | nibbles[:, 1::2] << 4).tobytes()
        width = TREES * DEPTH // 2
        sketches = pa.array([sketch[i * width : (i + 1) * width] for i in range(n)], pa.binary())
        for tree in range(TREES):
            keys = np.ascontiguousarray(sig[:, tree * DEPTH : (tree + 1) * DEPTH]).astype(">u4").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, tree, np.int32)), pa.array([keys[i * 4 * DEPTH : (i + 1) * 4 * DEPTH] for i in range(n)], pa.binary()), sketches, batch.column("c")], names=["tree", "key", "sketch", "c"])


def components_of(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each item's component, for links a - b among n items."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _neighbours(batches: Iterator[pa.RecordBatch], least: float, rows_at_once: int = 100_000) -> Iterator[pa.RecordBatch]:
    """Candidates among sorted neighbours, as an edge from each class to the smallest one it is connected with here."""
    held: list[pa.RecordBatch] = []

    def search(rows: pa.Table) -> pa.RecordBatch:
        n = rows.num_rows
        tree, c = rows.column("tree").to_numpy(), rows.column("c").to_numpy()
        key = np.frombuffer(b"".join(rows.column("key").to_pylist()), ">u4").reshape(n, DEPTH)
        sketch = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint8).reshape(n, -1)

        def shared(s: int) -> np.ndarray:
            """Values that each row's prefix has in common with the row s further."""
            same = np.logical_and.accumulate(key[:-s] == key[s:], axis=1).sum(axis=1)
            return np.where(tree[:-s] == tree[s:], same, 0)

        need = np.full(n, DEPTH)
        next_to = shared(1) if n > 1 else np.zeros(0, int)
        for d in range(DEPTH, FLOOR - 1, -1):  # the shortest prefix that few enough classes share
            region = np.cumsum(np.concatenate([[0], next_to < d]))
            need[np.bincount(region)[region] <= NEIGHBOURS + 1] = d
        ends = []
        for s in range(1, min(NEIGHBOURS, n - 1) + 1):
            common = shared(s)
            near = np.flatnonzero(common >= (FLOOR if s == 1 else np.minimum(need[:-s], need[s:])))
            match = _ZEROS[sketch[near] ^ sketch[near + s]].sum(axis=1) / (TREES * DEPTH)
            near = near[(match - 1 / 16) / (15 / 16) >= least]
            ends.append(np.stack([near, near + s]))
        a, b = np.concatenate(ends, axis=1) if ends else np.zeros((2, 0), int)
        order = np.argsort(c, kind="stable")
        place = np.empty(n, int)
        place[order] = np.arange(n)
        root = components_of(n, place[a], place[b])
        far = np.flatnonzero(root != np.arange(n))
        return pa.RecordBatch.from_arrays([pa.array(c[order[far]]), pa.array(c[order[root[far]]])], names=["a", "b"])

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= rows_at_once:
            rows = pa.Table.from_batches(held)
            yield search(rows)
            held = rows.slice(rows.num_rows - NEIGHBOURS).combine_chunks().to_batches()
    if held:
        yield search(pa.Table.from_batches(held))


def exact_links(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Component (smallest index) of each set under links of at least ``percent``: exact for any input.

    Two linked sets share one of the rarest shingles of both (prefix filter), so posting lists hold
    those alone and what many sets have in common costs nothing; partners are compared on full sets.
    """
    m = len(sets)
    size = np.array([len(s) for s in sets])
    flat, row = np.concatenate(sets), np.repeat(np.arange(m), size)
    _, ids, freq = np.unique(flat, return_inverse=True, return_counts=True)
    first = np.concatenate([[0], np.cumsum(size)])
    hub = int(np.argmax(np.bincount(row, weights=freq[ids]) / size))
    ids = ids[np.lexsort((ids, freq[ids], row))]  # each set from its rarest shingle on
    least = -(-percent * size // 100)  # shingles shared with any partner
    use = np.flatnonzero((np.arange(len(ids)) - first[row] <= (size - least)[row]) & (freq[ids] > 1))
    use = use[np.argsort(ids[use], kind="stable")]
    post, at = row[use], np.searchsorted(ids[use], np.arange(len(freq) + 1))
    mark = np.zeros(len(freq), bool)

    def spread(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
        return np.repeat(starts - (np.cumsum(lens) - lens), lens) + np.arange(lens.sum())

    def compared(i: int, others: np.ndarray) -> np.ndarray:
        """Those of the others that set i is linked with."""
        others = others[100 * np.minimum(size[i], size[others]) >= percent * np.maximum(size[i], size[others])]
        if not len(others):
            return others
        mine = ids[first[i] : first[i + 1]]
        mark[mine] = True
        lens = size[others]
        both = np.add.reduceat(mark[ids[spread(first[others], lens)]], np.cumsum(lens) - lens, dtype=np.int64)
        mark[mine] = False
        return others[100 * both >= percent * (size[i] + lens - both)]

    with_hub = compared(hub, np.arange(m))
    a, b = [np.full(len(with_hub), hub)], [with_hub]
    inside = np.zeros(m, bool)
    inside[with_hub] = True
    for i in np.flatnonzero(~inside):
        mine = ids[first[i] : first[i] + size[i] - least[i] + 1]
        lens = at[mine + 1] - at[mine]
        others = np.unique(post[spread(at[mine], lens)])
        found = compared(int(i), others[(others > i) | inside[others]])
        a.append(np.full(len(found), i))
        b.append(found)
    return components_of(m, np.concatenate(a), np.concatenate(b))


def _link(group: pa.Table, percent: int) -> pa.Table:
    """Edges from the members of a cell to the smallest one of their component."""
    group = group.sort_by("c")
    c = group.column("c").to_numpy()
    sets = [np.frombuffer(s, np.uint64) for s in group.column("grams").to_pylist()]
    root = exact_links(sets, percent)
    far = np.flatnonzero(root != np.arange(len(c)))
    return pa.table({"nb": pa.array(np.full(len(far), group.column("nb")[0].as_py(), np.int32)), "a": c[far], "b": c[root[far]]})


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, raw, offs in textkit.blocks(batch.column("text")):
            part = batch.slice(a, b - a)
            grams = pa.array([s.tobytes() for s in shingle_sets(raw, offs, size)], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("cluster"), part.column("nb"), part.column("c"), grams], names=["cluster", "nb", "c", "grams"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80, cell: int = CELL, cell_shingles: int = CELL_SHINGLES) -> DataFrame:
    """One row per input row: k (node key), th, n_shingles and component (smallest key of the component)."""
    ship.ensure(docs.sparkSession)
    rows = keyed(docs, id_col, text_col)
    signed = scratch.table(rows.mapInArrow(lambda it: _sign(it, size), "k long, th long, n long, h1 long, h2 long, sig binary"), "signed")
    classes = signed.where("n > 0").groupBy("h1", "h2").agg(F.min(F.struct("k", "th", "n")).alias("rep"), F.first("sig").alias("sig"))
    classes = scratch.table(classes.select("h1", "h2", F.col("rep.k").alias("c"), F.col("rep.th").alias("th"), F.col("rep.n").alias("n"), "sig"), "classes")
    forest = classes.mapInArrow(_plant, "tree int, key binary, sketch binary, c long").sort("tree", "key", "c")
    least = percent / 100 - SLACK
    clusters = graph.connected(forest.mapInArrow(lambda it: _neighbours(it, least), "a long, b long"))
    known = clusters.join(classes.select(F.col("c").alias("node"), "th", "n"), "node")
    sizes = known.groupBy("root").agg(F.greatest(F.ceil(F.count(F.lit(1)) / cell), F.ceil(F.sum("n") / cell_shingles)).cast("int").alias("nb"))
    members = known.join(sizes, "root").select(F.col("node").alias("k"), "th", F.col("root").alias("cluster"), "nb", F.col("node").alias("c"))
    # Rows that repeat doc_id and text would repeat their set, which changes nothing but the work.
    sets = rows.join(members, ["k", "th"]).mapInArrow(lambda it: _sets(it, size), "cluster long, nb int, c long, grams binary")
    own = F.pmod(F.xxhash64("c"), F.col("nb")).cast("int")
    cells = sets.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    cells = cells.select("cluster", "nb", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "c", "grams")
    links = scratch.table(cells.groupBy("cluster", "x", "y").applyInArrow(lambda g: _link(g, percent), "nb int, a long, b long"), "links")
    roots = links.where("nb = 1").select(F.col("a").alias("c"), F.col("b").alias("root"))
    across = links.where("nb > 1")
    if not across.isEmpty():
        roots = roots.unionByName(graph.connected(across.select("a", "b")).select(F.col("node").alias("c"), "root"))
    by_class = classes.select("h1", "h2", "c").join(roots, "c", "left").select("h1", "h2", F.coalesce("root", "c").alias("component"))
    full = signed.where("n > 0").select("k", "th", "n", "h1", "h2").join(by_class, ["h1", "h2"]).select("k", "th", "n", "component")
    empty = signed.where("n = 0").select("k", "th", "n", F.col("k").alias("component"))
    return full.unionByName(empty).withColumnRenamed("n", "n_shingles")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept."""
    found = near_duplicates(docs, id_col, text_col, size, percent)
    return found.select(visible(F.col("k")).alias("doc_id"), "n_shingles", visible(F.col("component")).alias("component_id"), (F.col("k") == F.col("component")).alias("kept"))
