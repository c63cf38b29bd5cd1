"""Property graph: nodes, edges, co-occurrence, and mining of them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import exprs
from tessera.functions.names import available
from tessera.operators import quantiles
from tessera.operators.running import numbered
from tessera.operators.staging import delete, folder, staged, written
from tessera.plans.specs import ContextSpec


def _contexts(df: DataFrame, specs: Sequence[ContextSpec], view: str) -> Column:
    """Array of (family, value, node_id) of a row."""
    have = [s for s in specs if s.column in df.columns]
    return F.array(*[F.struct(F.lit(s.family).alias("family"), exprs.clean(s.column).alias("value"), exprs.node_id(view, s.family, exprs.clean(s.column)).alias("node_id")) for s in have])


def _counted(df: DataFrame, specs: Sequence[ContextSpec], outcome: str) -> tuple[DataFrame, list[ContextSpec]]:
    """Rows and positives of each combination of context values, before any id is made, and the specifications of its columns."""
    have = [s for s in specs if s.column in df.columns]
    renamed = [ContextSpec(s.family, f"_c{i}") for i, s in enumerate(have)]
    rows = df.select(F.col(outcome).cast("long").alias("_y"), *[exprs.clean(s.column).alias(r.column) for s, r in zip(have, renamed)])
    return rows.groupBy(*[r.column for r in renamed]).agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("k")), renamed


def context_nodes(df: DataFrame, specs: Sequence[ContextSpec], outcome: str, view: str = "context") -> DataFrame:
    """Distinct (family, value) nodes with rows, positives and rate, in one pass."""
    counted, renamed = _counted(df, specs, outcome)
    long = counted.select("n", "k", F.inline(_contexts(counted, renamed, view)))
    return long.groupBy("node_id", "family", "value").agg(F.sum("n").alias("row_count"), F.sum("k").alias("outcome_count"), (F.sum("k") / F.sum("n")).alias("outcome_rate"))


def membership_edges(df: DataFrame, node: str, session: str, view: str = "warehouse") -> DataFrame:
    """measurement -> session."""
    return df.select(exprs.edge_id(view, "belongs_to_session", node, session).alias("edge_id"), F.col(node).alias("source"), exprs.node_id(view, "session", session).alias("target"), F.lit("belongs_to_session").alias("edge_type"))


def context_edges(df: DataFrame, node: str, specs: Sequence[ContextSpec], view: str = "warehouse", distinct: bool = False) -> DataFrame:
    """measurement -> context value, one for each row and family; with ``distinct``, equal ones once, before their ids are made."""
    long = df.select(F.col(node).alias("source"), F.inline(_contexts(df, specs, view))).select("source", "family", "node_id")
    long = long.distinct() if distinct else long
    return long.select(exprs.edge_id(view, "has_context", "source", "node_id").alias("edge_id"), "source", F.col("node_id").alias("target"), F.concat(F.lit("has_"), "family").alias("edge_type"))


def cooccurrence(df: DataFrame, specs: Sequence[ContextSpec], outcome: str, view: str = "context") -> DataFrame:
    """Edges between context values that occur together, with support, rate, baseline and lift.

    Rows with equal contexts are counted once, then ids and pairs are made inside the row; values are
    ordered by family, so a pair has one orientation.
    """
    counted, renamed = _counted(df, specs, outcome)
    rows = counted.select(F.array_sort(_contexts(counted, renamed, view)).alias("e"), "n", "k")
    total = rows.agg(F.sum("n").alias("all_n"), F.sum("k").alias("all_k"))
    pairs = F.flatten(F.transform("e", lambda a, i: F.transform(F.slice("e", i + 2, F.size("e")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    long = rows.select(F.explode(pairs).alias("p"), "n", "k").groupBy(F.col("p.a.node_id").alias("source"), F.col("p.b.node_id").alias("target")).agg(F.sum("n").alias("row_count"), F.sum("k").alias("outcome_count"))
    baseline = F.col("all_k") / F.col("all_n")
    out = long.crossJoin(F.broadcast(total)).withColumn("outcome_rate", F.col("outcome_count") / F.col("row_count"))
    return out.select("source", "target", "row_count", "outcome_count", "outcome_rate", baseline.alias("baseline_rate"), F.when(baseline > 0, F.col("outcome_rate") / baseline).alias("lift"), (F.col("row_count") / F.col("all_n")).alias("support"))


def high_lift_edges(edges: DataFrame, least: int = 25, limit: int = 100) -> DataFrame:
    """Edges with at least max(least, whole part of the first quartile) rows and a lift of 1 or more, the best first."""
    bound = quantiles.quantiles(edges, [], "row_count", {"q": 0.25}).agg(F.max(F.greatest(F.lit(least), F.floor("q"))).alias("bound"))  # one row; edges below are none where there is no quantile
    kept = edges.crossJoin(F.broadcast(bound)).where((F.col("row_count") >= F.col("bound")) & (F.col("lift") >= 1)).drop("bound")
    return kept.orderBy(F.desc("lift"), F.desc("outcome_rate"), F.desc("row_count"), "source", "target").limit(limit)


def degrees(nodes: DataFrame, edges: DataFrame, weight: Column | None = None) -> DataFrame:
    """Degree and weighted degree over both end points; isolated nodes have 0, a loop counts twice."""
    w = F.lit(1.0) if weight is None else weight
    ends = edges.select(F.explode(F.array("source", "target")).alias("node_id"), w.cast("double").alias("w"))
    sums = ends.groupBy("node_id").agg(F.count(F.lit(1)).alias("degree"), F.sum("w").alias("weighted_degree"))
    return nodes.join(sums, "node_id", "left").withColumns({"degree": F.coalesce("degree", F.lit(0)), "weighted_degree": F.coalesce("weighted_degree", F.lit(0.0))})


def top_nodes(ranked: DataFrame, group: str, k: int = 25) -> DataFrame:
    """The k nodes of each group with the highest weighted degree, then degree, then id."""
    w = Window.partitionBy(group).orderBy(F.desc("weighted_degree"), F.desc("degree"), "node_id")
    return ranked.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """End points of edges that are no node."""
    return edges.select(F.explode(F.array("source", "target")).alias("node_id")).distinct().join(nodes.select("node_id"), "node_id", "left_anti")


def duplicate_ids(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def pivot_contexts(edges: DataFrame, types: Sequence[str]) -> DataFrame:
    """One row for each source: the first target of each edge type."""
    return edges.groupBy("source").pivot("edge_type", list(types)).agg(F.min("target"))


def symmetric(edges: DataFrame, weight: str) -> DataFrame:
    """Both directions, weights of repeated edges added."""
    both = edges.select("source", "target", weight).unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target"), weight))
    return both.groupBy("source", "target").agg(F.sum(weight).alias(weight))


def label_propagation(edges: DataFrame, weight: str, sweeps: int = 10, few: int = 50_000) -> DataFrame:
    """Asynchronous weighted label propagation: nodes by descending weight then id, ties to the smallest label, compact ids.

    A node waits only for the neighbours before it in the order, so nodes fall into levels that can move
    together, and a sweep is one join for each level (``by_levels``).  Up to ``few`` directed edges, one task
    sweeps through them.  Both give the labels of the sequential sweep; votes are sums of doubles.
    """
    sym = staged(symmetric(edges, weight))
    labels = _swept(sym, weight, sweeps) if sym.count() <= few else by_levels(sym, weight, sweeps)
    ids = numbered(labels.select("label").distinct(), [F.col("label")], "_id").select("label", (F.col("_id") - 1).alias("community"))
    return labels.join(ids, "label").select("node_id", "community")


def _swept(sym: DataFrame, weight: str, sweeps: int) -> DataFrame:
    """(node_id, label) of a small graph, one node after the other."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        near: dict[str, dict[str, float]] = {}
        for pdf in frames:
            for s, t, w in zip(pdf["source"], pdf["target"], pdf[weight]):
                near.setdefault(s, {})[t] = float(w)
        label = {n: n for n in near}
        order = sorted(near, key=lambda n: (-sum(near[n].values()), n))
        for _ in range(sweeps):
            moved = False
            for n in order:
                votes: dict[str, float] = {}
                for m, w in near[n].items():
                    votes[label[m]] = votes.get(label[m], 0.0) + w
                best = min(votes, key=lambda c: (-votes[c], c))
                moved |= best != label[n]
                label[n] = best
            if not moved:
                break
        yield pd.DataFrame({"node_id": list(label), "label": list(label.values())}).astype({"node_id": str, "label": str})

    return sym.select("source", "target", F.col(weight).cast("double").alias(weight)).repartition(1).mapInPandas(run, "node_id string, label string")


def update_levels(sym: DataFrame, weight: str) -> DataFrame:
    """(node_id, level): 1 for nodes before all their neighbours in the order of updates, else one more than the highest level of a neighbour before them.

    Level by level, nodes that no open neighbour comes before are taken out; links of nodes that are out
    no longer count, so the table of open links shrinks.
    """
    strength = staged(sym.groupBy("source").agg(F.sum(F.col(weight).cast("double")).alias("s")))
    ends = sym.where("source <> target").select("source", "target").join(strength, "source").join(strength.select(F.col("source").alias("target"), F.col("s").alias("t")), "target")
    waits = ends.where((F.col("t") > F.col("s")) | ((F.col("t") == F.col("s")) & (F.col("target") < F.col("source")))).select("source", "target")
    spark, nodes = sym.sparkSession, strength.select(F.col("source").alias("node_id"))
    (waits, last), (nodes, rest), out, level = written(waits), written(nodes), None, 0
    while not nodes.isEmpty():
        level += 1
        free = staged(nodes.join(waits.select(F.col("source").alias("node_id")).distinct(), "node_id", "left_anti"))
        out = (lambda new: new if out is None else out.unionByName(new))(free.withColumn("level", F.lit(level)))
        if level % 20 == 0:
            out = staged(out)
        open_waits, new_last = written(waits.join(free.withColumnRenamed("node_id", "target"), "target", "left_anti").select("source", "target"))
        open_nodes, new_rest = written(nodes.join(free, "node_id", "left_anti"))
        delete(spark, last, rest)
        waits, nodes, last, rest = open_waits, open_nodes, new_last, new_rest
    return spark.createDataFrame([], "node_id string, level int") if out is None else out


def by_levels(sym: DataFrame, weight: str, sweeps: int) -> DataFrame:
    """(node_id, label) after so many sweeps, or when nothing moves: one join and one aggregate for each level.

    Nodes of one level are no neighbours, so their votes come from levels before, with this sweep's labels,
    and from levels behind, with the last sweep's; each level's labels are a table of their own.
    """
    spark = sym.sparkSession
    levels = staged(update_levels(sym, weight))
    leveled, at = written(sym.join(levels.withColumnRenamed("node_id", "source"), "source").select("source", "target", F.col(weight).cast("double").alias("w"), "level"), "level")
    schema = "node_id string, label string"
    paths = {}
    for level in range(1, (levels.agg(F.max("level")).first()[0] or 0) + 1):
        paths[level] = written(levels.where(F.col("level") == level).select("node_id", F.col("node_id").alias("label")))[1]
    now = lambda: spark.read.schema(schema).parquet(*paths.values())
    for _ in range(sweeps):
        moved = False
        for level, old in list(paths.items()):
            mine = leveled.where(F.col("level") == level)
            votes = mine.join(now().withColumnRenamed("node_id", "target"), "target").groupBy("source", "label").agg(F.sum("w").alias("w"))
            best = votes.groupBy(F.col("source").alias("node_id")).agg(F.min_by("label", F.struct(-F.col("w"), F.col("label"))).alias("label"))
            new, path = written(best)
            before = spark.read.schema(schema).parquet(old).withColumnRenamed("label", "before")
            moved = moved or not new.join(before, "node_id").where("label <> before").isEmpty()
            paths[level] = path
            delete(spark, old)
        if not moved:
            break
    out = staged(now()) if paths else spark.createDataFrame([], schema)
    delete(spark, at, *paths.values())
    return out


def components(nodes: DataFrame, edges: DataFrame, rounds: int = 50) -> DataFrame:
    """Connected components by smallest reachable id: neighbours' minima joined with pointer jumping, checkpointed each round."""
    both = edges.select("source", "target").unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target"))).distinct()
    now = nodes.select("node_id", F.col("node_id").alias("component"))
    for _ in range(rounds):
        least = both.join(now.withColumnRenamed("node_id", "target"), "target").groupBy(F.col("source").alias("node_id")).agg(F.min("component").alias("near"))
        step = now.join(least, "node_id", "left").select("node_id", "component", F.least("component", F.coalesce("near", "component")).alias("next"))
        jump = step.select(F.col("node_id").alias("next"), F.col("next").alias("far"))
        new = step.join(jump, "next", "left").select("node_id", "component", F.least("next", F.coalesce("far", "next")).alias("new"))
        new = _cut(new)
        changed = not new.where(F.col("new") != F.col("component")).isEmpty()
        now = new.select("node_id", F.col("new").alias("component"))
        if not changed:
            return now
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def _cut(df: DataFrame) -> DataFrame:
    """Checkpoint into the shared folder; one of our own only where none is set."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder(df.sparkSession))
    return df.checkpoint()


def target_rates(df: DataFrame, column: str, outcome: str, is_test: str) -> DataFrame:
    """Train-only mean of the outcome for each value, the global train mean for unseen ones."""
    train = df.where(~F.col(is_test))
    rates = train.groupBy(column).agg((F.sum(F.col(outcome).cast("long")) / F.count(F.lit(1))).alias("rate"))
    overall = train.agg((F.sum(F.col(outcome).cast("long")) / F.count(F.lit(1))).alias("overall"))
    return df.join(rates, column, "left").crossJoin(F.broadcast(overall)).withColumn("target_rate", F.coalesce("rate", "overall")).drop("rate", "overall")


def neighbour_mean(values: DataFrame, edges: DataFrame, columns: Sequence[str], rounds: int = 2) -> DataFrame:
    """Mean over each node and its neighbours, repeated: the feature propagation of a simplified graph network."""
    both = edges.select("source", "target").unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target"))).distinct()
    loops = values.select(F.col("node_id").alias("source"), F.col("node_id").alias("target"))
    hood = both.unionByName(loops).distinct()
    for _ in range(rounds):
        values = hood.join(values.withColumnRenamed("node_id", "target"), "target").groupBy(F.col("source").alias("node_id")).agg(*[F.avg(c).alias(c) for c in available(values, columns)])
    return values


def evidence_graph(distances: DataFrame, main: str, view: str = "evidence") -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of pairwise comparisons: each comparison points at its metric and at both sources."""
    key = F.concat_ws("|", F.col("metric"), F.lit(main), F.col("reference"))
    node = lambda kind, value: F.struct(F.lit(kind).alias("node_type"), value.alias("node_label"))
    nodes = distances.select(F.inline(F.array(node("metric", F.col("metric")), node("source", F.lit(main)), node("source", F.col("reference")), node("comparison", key)))).distinct()
    kinds = ("metric", "source", "comparison")
    ids = F.lit(None).cast("string")
    for kind in kinds:
        ids = F.when(F.col("node_type") == kind, exprs.node_id(view, kind, "node_label")).otherwise(ids)
    source = exprs.node_id(view, "comparison", key)
    ends = (("compares_metric", exprs.node_id(view, "metric", "metric")), ("compares_main", exprs.node_id(view, "source", F.lit(main))), ("compares_reference", exprs.node_id(view, "source", "reference")))
    edges = distances.select(F.inline(F.array(*[F.struct(exprs.edge_id(view, kind, source, target).alias("edge_id"), source.alias("source"), target.alias("target"), F.lit(kind).alias("edge_type")) for kind, target in ends])))
    return nodes.select(ids.alias("node_id"), "node_type", "node_label"), edges


def view_summary(nodes: DataFrame, edges: DataFrame, view: str = "graph_view") -> DataFrame:
    """Nodes and edges of each view, views that have only one of them included."""
    n = nodes.groupBy(view).agg(F.count(F.lit(1)).alias("nodes"))
    e = edges.groupBy(view).agg(F.count(F.lit(1)).alias("edges"))
    return n.join(e, view, "full").withColumns({"nodes": F.coalesce("nodes", F.lit(0)), "edges": F.coalesce("edges", F.lit(0))})
