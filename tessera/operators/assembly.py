"""Node and edge tables of the property graph, their audit, and the tables that report on them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import exprs
from tessera.functions.names import available
from tessera.sources.tables import union_sources


def measurement_nodes(df: DataFrame, node: str, attributes: Sequence[str], view: str = "warehouse") -> DataFrame:
    """One node for each measurement, with those of the attributes that exist; a repeated id is one node with its largest values."""
    have = available(df, attributes)
    one = df.groupBy(F.col(node).cast("string").alias("node_label")).agg(*[F.max(c).alias(c) for c in have]) if have else df.select(F.col(node).cast("string").alias("node_label")).distinct()
    return one.select(F.col("node_label").alias("node_id"), F.lit("measurement").alias("node_type"), "node_label", F.lit(view).alias("graph_view"), *have)


def session_nodes(df: DataFrame, session: str, outcome: str, view: str = "warehouse") -> DataFrame:
    """One node for each session with rows, positives and rate."""
    y = F.col(outcome).cast("long")
    rates = df.groupBy(F.col(session).cast("string").alias("node_label")).agg(F.count(F.lit(1)).alias("row_count"), F.sum(y).alias("outcome_count"))
    return rates.select(exprs.node_id(view, "session", "node_label").alias("node_id"), F.lit("session").alias("node_type"), "node_label", F.lit(view).alias("graph_view"), "row_count", "outcome_count", (F.col("outcome_count") / F.col("row_count")).alias("outcome_rate"))


def assemble(nodes: Sequence[DataFrame], edges: Sequence[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """All nodes and all edges, absent attributes null."""
    return union_sources(nodes), union_sources(edges)


def graph_audit(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows, repeated ids and end points that are no node: check_name, n, status.

    Ids travel as 128 bits of hash, whatever their length, and each table is read once: nodes and end points
    are counted together, and edge ids by themselves.
    """
    short = lambda c: F.struct(F.xxhash64(c).alias("a"), F.xxhash64(F.lit(1), c).alias("b"))
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    ends = edges.select(F.explode(F.array("source", "target")).alias("x")).select(short("x").alias("x"), F.col("x").isNotNull().alias("known"), none.alias("n"), F.lit(True).alias("end"))
    points = nodes.select(short("node_id").alias("x"), F.col("node_id").isNotNull().alias("known"), one.alias("n"), F.lit(False).alias("end")).unionByName(ends)
    seen = points.groupBy("x.a", "x.b", "known").agg(F.sum("n").alias("n"), F.max("end").alias("end"))
    lone = (F.col("n") == 0) | ~F.col("known")  # a null end point is no node, not even where a node's id is null
    by_node = seen.agg(F.coalesce(F.sum("n"), none).alias("node_rows"), F.count_if(F.col("n") > 1).alias("repeated_node_ids"), F.count_if(F.col("end") & lone).alias("dangling_end_points"))
    ids = edges.select(short("edge_id").alias("x"), F.col("edge_id").isNull().alias("null")).groupBy("x.a", "x.b", "null").agg(F.count(F.lit(1)).alias("n"))
    by_edge = ids.agg(F.coalesce(F.sum("n"), none).alias("edge_rows"), F.count_if(F.col("n") > 1).alias("repeated_edge_ids"))
    both = by_node.crossJoin(by_edge)  # one row each
    checks = ("node_rows", "edge_rows", "repeated_node_ids", "repeated_edge_ids", "dangling_end_points")
    long = both.select(F.inline(F.array(*[F.struct(F.lit(c).alias("check_name"), F.col(c).alias("n")) for c in checks])))
    fine = F.when(F.col("check_name").endswith("_rows"), F.col("n") > 0).otherwise(F.col("n") == 0)
    return long.select("check_name", "n", F.when(fine, "ok").otherwise("review").alias("status"))


def context_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Context nodes with their incident edges, the rows on these, and the largest lift; none is 0 and null."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("node_id"), "row_count", "lift")
    sums = ends.groupBy("node_id").agg(F.count(F.lit(1)).alias("incident_edges"), F.sum("row_count").alias("incident_rows"), F.max("lift").alias("max_lift"))
    out = nodes.join(sums, "node_id", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("incident_edges", "incident_rows")})


def scope_table(counts: DataFrame, roles: Mapping[str, str], view: str = "graph_view") -> DataFrame:
    """Role text and counts of each view that ``roles`` names, in its order; a view without rows has 0."""
    named = counts.sparkSession.createDataFrame([(i, v, t) for i, (v, t) in enumerate(roles.items())], f"position int, {view} string, role string")
    return named.join(counts, view, "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("nodes", "edges")})


def ranked_comparisons(distances: DataFrame, limit: int | None = None) -> DataFrame:
    """Comparisons with a statistic, the largest distance first (a report)."""
    out = distances.where(F.col("ks").isNotNull()).orderBy(F.desc("ks"), F.desc("wasserstein"), "metric", "reference")
    return out if limit is None else out.limit(limit)


def degree_features(nodes: DataFrame, transitions: DataFrame, others: DataFrame) -> DataFrame:
    """Transitions into and out of each node, and its edges of any kind."""
    ends = [transitions.select(F.col("target").alias("node_id"), F.lit(1).alias("i"), F.lit(0).alias("o")), transitions.select(F.col("source").alias("node_id"), F.lit(0).alias("i"), F.lit(1).alias("o"))]
    ends += [others.select(F.col(c).alias("node_id"), F.lit(0).alias("i"), F.lit(0).alias("o")) for c in ("source", "target")]
    sums = union_sources(ends).groupBy("node_id").agg(F.sum("i").alias("transition_in"), F.sum("o").alias("transition_out"), F.count(F.lit(1)).alias("total_degree"))
    out = nodes.select("node_id").join(sums, "node_id", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("transition_in", "transition_out", "total_degree")})


def lookup(column: str | Column, values: Mapping[str, str], default: Column | None = None) -> Column:
    """A label, an order or a role from a dictionary; otherwise the default (null without one)."""
    key = F.col(column) if isinstance(column, str) else column
    found = F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key) if values else F.lit(None)
    return found if default is None else F.coalesce(found, default)
