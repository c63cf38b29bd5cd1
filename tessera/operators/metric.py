"""An exact metric index: Voronoi cells of pivots, cut into rings, and bounds from the triangle inequality.

Every vector belongs to its nearest pivot; the rows of a cell are numbered by their distance to it and
cut into blocks of ``ROWS``, so a block is a ring of a cell, of bounded size however dense the cell is.
Of each block are known the range of distances to its own pivot and, for every pivot j, the least and the
largest distance of its rows to j and the least lead ``d(x, j) - d(x, own)``.  For rows x of a block and y
of a block of j's cell,

    d(x, y) >= d(x, j) - d(y, j)      d(x, y) >= d(y, j) - d(x, j)      d(x, y) >= (d(x, j) - d(x, own)) / 2

so pairs of blocks in which nothing can be near enough are never made.  Pivots are means of a bounded
sample in hash order (``SAMPLE``), at most ``PIVOTS`` of them; they are all that is sent to every task.
The answers do not depend on the pivots, only the number of pairs does: vectors without any structure
keep all pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, StructField, StructType

from tessera.operators.running import numbered
from tessera.operators.staging import staged

ROWS, SAMPLE, PIVOTS, LLOYD = 2048, 4000, 1024, 5
#: Most blocks of a tile's left and right side, most bytes of either, and groups that the left blocks are cut into while ``TILE`` allows.
TILE, WIDE, TILE_BYTES, GROUPS = 16, 64, 1 << 25, 24


def matrix(rows: pa.StructArray | pa.RecordBatch, name: str = "v") -> np.ndarray:
    """The vectors of a list field, one in each row."""
    side = rows.field(name) if isinstance(rows, pa.StructArray) else rows.column(name)
    return side.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(side), -1)


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all rows of y; rounding may put them a little below zero."""
    out = x @ y.T
    out *= -2
    out += (x**2).sum(axis=1)[:, None]
    out += (y**2).sum(axis=1)[None, :]
    return out


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(squares(x, y), 0))


@dataclass(frozen=True)
class Index:
    """``blocks``: block, pivot, lo, hi (distances to the own pivot), near, far, lead (one entry a pivot), rows (array of structs with v), and for pairs x and tags (see ``packed``)."""

    blocks: DataFrame
    pivots: np.ndarray
    slack: float


def to_bytes(x: np.ndarray) -> bytes:
    """Eight bytes that tell the width of a number, then the numbers: four bytes each where that loses nothing."""
    short = x.astype(np.float32)
    out = short if (short == x).all() else x
    return np.int64(out.itemsize).tobytes() + out.tobytes()


def from_bytes(data: pa.Buffer, rows: int) -> np.ndarray:
    kind = np.float32 if np.frombuffer(data, np.int64, 1)[0] == 4 else np.float64
    return np.frombuffer(data, kind, offset=8).astype(float).reshape(rows, -1)


def packed(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Adds x (the vectors of ``rows`` as bytes) and tags (the other columns of ``rows``): what travels to pairs of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part = batch.slice(i, 1)
                x = pa.array([to_bytes(matrix(part.column("rows")[0].values))], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, x], names=[*part.schema.names, "x"])

    with_x = df.mapInArrow(run, StructType([*df.schema.fields, StructField("x", BinaryType())]))
    return with_x.withColumn("tags", F.transform("rows", lambda r: F.struct(*[r[c] for c in columns] or [F.lit(True).alias("row")])))


def pivots_of(df: DataFrame, rows: int = ROWS) -> np.ndarray:
    """Means of a bounded sample: one for about ``rows`` vectors, from points far from each other by a few rounds of Lloyd."""
    count = df.count()
    found = df.select("v").orderBy(F.xxhash64("v"), "v").limit(SAMPLE).toPandas()["v"]
    if not len(found):
        return np.zeros((1, 0))
    x = np.stack(found.to_numpy()).astype(float)
    chosen, near = [0], np.full(len(x), np.inf)
    for _ in range(min(PIVOTS, -(-count // rows), len(x)) - 1):
        near = np.minimum(near, distances(x, x[chosen[-1:]])[:, 0])
        chosen.append(int(near.argmax()))
    centres = x[chosen]
    for _ in range(LLOYD):
        own = squares(x, centres).argmin(axis=1)
        n = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def build(df: DataFrame, columns: Sequence[str], pivots: np.ndarray | None = None, rows: int | None = None) -> Index:
    """Index the rows of ``df`` by their vectors ``v`` (arrays of one length, no nulls); blocks keep v and ``columns``."""
    rows = ROWS if rows is None else rows
    df = staged(df.select(F.col("v").cast("array<double>").alias("v"), *columns))
    pivots = pivots_of(df, rows) if pivots is None else pivots
    if not pivots.size:
        pivots = np.zeros((1, 0))  # an index of no rows; whatever is asked lies in its one empty cell

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                x = matrix(part)
                d = distances(x, pivots if pivots.size else np.zeros((1, x.shape[1])))
                nearest = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(nearest.astype(np.int32)), pa.array(d[np.arange(len(d)), nearest])], names=[*part.schema.names, "pivot", "apart"])

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part = batch.slice(i, 1)
                x = matrix(part.column("rows")[0].values)
                d = distances(x, pivots if pivots.size else np.zeros((1, x.shape[1])))
                lead = d - d[:, [part.column("pivot")[0].as_py()]]
                extra = [pa.array([v.tolist()], pa.list_(pa.float64())) for v in (d.min(axis=0), d.max(axis=0), lead.min(axis=0))]
                yield pa.RecordBatch.from_arrays([*part.columns, *extra], names=[*part.schema.names, "near", "far", "lead"])

    dealt = df.mapInArrow(own, StructType([*df.schema.fields, StructField("pivot", IntegerType()), StructField("apart", DoubleType())]))
    dealt = numbered(dealt, [F.col("apart"), F.xxhash64("v")], "nth", ["pivot"])
    block = (F.col("pivot").cast("long") * F.lit(1 << 40) + F.expr(f"(nth - 1) div {rows}")).alias("block")
    ringed = dealt.groupBy(block, "pivot").agg(F.min("apart").alias("lo"), F.max("apart").alias("hi"), F.collect_list(F.struct("v", *columns)).alias("rows"))
    full = StructType([*ringed.schema.fields, *[StructField(name, ArrayType(DoubleType())) for name in ("near", "far", "lead")]])
    widest = float(np.abs(pivots).max(initial=0.0))
    return Index(staged(packed(ringed.mapInArrow(bounds, full), columns)), pivots, 1e-6 * (1 + widest))


def candidates(left: Index, right: Index, reach: Column, half: bool = False) -> DataFrame:
    """(block_a, block_b, apart): pairs of blocks that may hold rows within ``reach``, a column of the left blocks; the bound on their distance.

    Both indexes have the same pivots.  ``half`` leaves out the mirror images of an index with itself.
    """
    slack = max(left.slack, right.slack)
    each = left.blocks.select(F.col("block").alias("block_a"), (reach + slack).alias("reach"), F.inline(F.arrays_zip(F.sequence(F.lit(0), F.lit(len(left.pivots) - 1)).alias("pivot"), "near", "far", F.transform("lead", lambda x: x / 2).alias("lead"))))
    each = each.where("lead <= reach")
    heads = right.blocks.select(F.col("block").alias("block_b"), "pivot", "lo", "hi")
    apart = F.greatest(F.lit(0.0), F.col("lead"), F.col("near") - F.col("hi"), F.col("lo") - F.col("far"))
    pairs = each.join(heads, "pivot").select("block_a", "block_b", "reach", apart.alias("apart")).where("apart <= reach")
    return (pairs.where("block_a <= block_b") if half else pairs).select("block_a", "block_b", "apart")


@dataclass(frozen=True)
class Side:
    """One block of a pair; ``apart`` is the bound on the distance of a left one's rows to the other's."""

    block: int
    x: np.ndarray
    tags: pa.StructArray
    apart: float = 0.0

    def tag(self, name: str) -> np.ndarray:
        return self.tags.field(name).to_numpy(zero_copy_only=False)


def tiled(pairs: DataFrame, left: DataFrame, right: DataFrame, run: Callable[[Iterator[tuple[Side, Side]]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What ``run`` gives for the pairs of each tile; left and right have block, x and tags.

    The blocks of either side are cut into groups of neighbours in their order, and the pairs of two groups are a
    tile, which one task takes.  A block travels once for each tile that needs it, not once for each of its pairs,
    and a tile is bounded however many pairs a block has: by ``TILE`` blocks of the left side, ``WIDE`` of the right
    one and ``TILE_BYTES`` of either.  In a tile the pairs of a left block come one after the other, nearest first.
    """

    def groups(side: DataFrame, name: str, most: int, few: bool) -> DataFrame:
        size = side.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.length("x")), F.lit(1)).alias("bytes")).first()
        most = max(1, min(most, TILE_BYTES // max(1, size["bytes"])))
        if few:
            most = min(most, max(1, -(-size["n"] // GROUPS)))
        ranked = numbered(side.select("block"), [F.col("block")], "nth")
        return ranked.select(F.col("block").alias(f"block_{name}"), F.expr(f"(nth - 1) div {most}").alias(f"group_{name}"))

    tiles = staged(pairs.select("block_a", "block_b", "apart").join(groups(left, "a", TILE, True), "block_a").join(groups(right, "b", WIDE, False), "block_b"))
    key = ["group_a", "group_b"]
    asked = tiles.groupBy(*key, F.col("block_a").alias("block")).agg(F.sort_array(F.collect_list(F.struct("apart", F.col("block_b").alias("other")))).alias("others"))
    met = tiles.select(*key, F.col("block_b").alias("block")).distinct()
    sent = asked.join(left.select("block", "x", F.col("tags").alias("a")), "block").unionByName(met.join(right.select("block", "x", F.col("tags").alias("b")), "block"), allowMissingColumns=True)
    empty = to_arrow_schema(StructType.fromDDL(schema)).empty_table()

    def tile(table: pa.Table) -> pa.Table:
        mine, theirs = {}, {}
        for batch in table.to_batches():
            for i in range(batch.num_rows):
                (mine if batch.column("others")[i].is_valid else theirs)[batch.column("block")[i].as_py()] = batch, i

        def side(block: int, at: tuple[pa.RecordBatch, int], name: str) -> Side:
            batch, i = at
            tags = batch.column(name)[i].values
            return Side(block, from_bytes(batch.column("x")[i].as_buffer(), len(tags)), tags)

        def each() -> Iterator[tuple[Side, Side]]:
            for block in sorted(mine):
                a = side(block, mine[block], "a")
                for other in mine[block][0].column("others")[mine[block][1]].as_py():
                    yield replace(a, apart=other["apart"]), side(other["other"], theirs[other["other"]], "b")

        found = list(run(each()))
        return pa.Table.from_batches(found) if found else empty

    return sent.groupBy(*key).applyInArrow(tile, schema)


def near_counts(asked: Index, points: Index, eps: float, weight: str, enough: float = np.inf) -> DataFrame:
    """(id, n): summed weights of the points within ``eps`` of every asked row that has any; ids are unique.

    A tile takes its blocks that may reach a block of asked rows one after the other and gives one row for each
    of its rows; rows that have ``enough`` are not compared any more, so their n says no more than that.
    """

    def count(pairs: Iterator[tuple[Side, Side]]) -> Iterator[pa.RecordBatch]:
        held: tuple[Side, np.ndarray] | None = None

        def out() -> pa.RecordBatch:
            side, n = held
            return pa.RecordBatch.from_arrays([pa.array(side.tag("id")[n > 0], pa.int64()), pa.array(n[n > 0].astype(np.int64))], names=["id", "n"])

        for a, b in pairs:
            if held is None or held[0].block != a.block:
                if held is not None:
                    yield out()
                held = a, np.zeros(len(a.x))
            todo = np.flatnonzero(held[1] < enough)
            if len(todo):
                held[1][todo] += (squares(a.x[todo], b.x) <= eps * eps + 1e-12) @ b.tag(weight).astype(float)  # counts below 2^53
        if held is not None:
            yield out()

    found = tiled(candidates(asked, points, F.lit(float(eps))), asked.blocks, points.blocks, count, "id long, n long")
    return found.groupBy("id").agg(F.sum("n").alias("n"))


def radius_for(asked: Index, points: Index, k: int) -> DataFrame:
    """(block, reach): within this distance each row of an asked block has its k nearest of the points, or all if there are fewer.

    First by the cells: a pivot's members lie within its radius of it.  Then each block meets one block of
    points that seems nearest, whose k-th distance is a tighter bound.
    """
    cells = points.blocks.groupBy("pivot").agg(F.sum(F.size("rows")).alias("n"), F.max("hi").alias("radius")).toPandas()  # a row for each pivot
    which, n, radius = (cells[c].to_numpy() for c in ("pivot", "n", "radius"))
    pivots = asked.pivots

    def loose(x: np.ndarray) -> np.ndarray:
        upper = distances(x, pivots[which]) + radius[None, :]
        order = np.argsort(upper, axis=1)
        enough = np.cumsum(n[order], axis=1) >= k
        at = np.where(enough.any(axis=1), enough.argmax(axis=1), len(which) - 1)
        return np.take_along_axis(upper, np.take_along_axis(order, at[:, None], axis=1), axis=1)[:, 0]

    def by_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [float(loose(matrix(batch.column("rows")[i].values)).max()) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array(out, pa.float64())], names=["block", "reach"])

    def by_one_block(pairs: Iterator[tuple[Side, Side]]) -> Iterator[pa.RecordBatch]:
        for a, b in pairs:
            bound = loose(a.x)
            if len(b.x) >= k:
                bound = np.minimum(bound, np.sqrt(np.maximum(np.partition(squares(a.x, b.x), k - 1, axis=1)[:, k - 1], 0)))
            yield pa.RecordBatch.from_arrays([pa.array([a.block]), pa.array([float(bound.max())])], names=["block", "reach"])

    if not len(cells):
        return asked.blocks.select("block", F.lit(0.0).alias("reach"))
    first = staged(asked.blocks.select("block", "rows").mapInArrow(by_cells, "block long, reach double"))
    with_reach = Index(asked.blocks.join(first, "block"), pivots, asked.slack)
    middle = points.blocks.select(F.col("block").alias("block_b"), ((F.col("lo") + F.col("hi")) / 2).alias("middle"))
    seems = candidates(with_reach, points, F.col("reach")).join(middle, "block_b")
    one = seems.groupBy("block_a").agg(F.min_by("block_b", F.struct("apart", "middle", "block_b")).alias("block_b"), F.min("apart").alias("apart"))
    return tiled(one, asked.blocks, points.blocks, by_one_block, "block long, reach double")


def nearest(asked: Index, points: Index, k: int, run: Callable[[Iterator[tuple[Side, Side]]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What ``run`` gives for tiles of pairs of blocks that together hold the k nearest points of every asked row."""
    reach = staged(radius_for(asked, points, k))
    with_reach = Index(asked.blocks.join(reach, "block"), asked.pivots, asked.slack)
    return tiled(candidates(with_reach, points, F.col("reach")), asked.blocks, points.blocks, run, schema)
