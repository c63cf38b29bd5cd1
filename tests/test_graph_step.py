"""Joins of the order lines, edges of repeated measurements, and the audit on odd ids."""

from pyspark.sql import functions as F

from tessera.operators import assembly, patterns
from tessera.plans import bindings as b
from tessera.plans import stages

SF = "/root/testdata/sf0.001"


def test_lines_are_joined_last(spark):
    """Lines meet one table of orders that has its customers and areas, so only one join reads them."""
    plan = b.lines(spark, SF, area=True).select("measurement_id", "r_name", "c_mktsegment")._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join LeftOuter" in line]
    assert len(joins) == 4 and "l_orderkey" in joins[0] and not any("l_orderkey" in line for line in joins[1:])
    assert not [line for line in joins[1:] if line.lstrip(" :+-|").startswith("l_")]


def test_edges_of_repeated_measurements(spark):
    rows = b.lines(spark, SF, area=True).limit(50)
    other = rows.withColumn("r_name", F.lit("elsewhere"))
    nodes, edges = stages.assembled(rows.unionByName(rows).unionByName(other))
    n = rows.select("measurement_id").distinct().count()
    assert edges.count() == edges.distinct().count() == n * 8  # session, six contexts, and the other area
    found = {r.check_name: (r.n, r.status) for r in assembly.graph_audit(nodes, edges).collect()}
    assert found["edge_rows"] == (n * 8, "ok") and found["dangling_end_points"] == (0, "ok") and found["repeated_node_ids"] == (0, "ok")


def test_audit_reads_each_table_once(spark):
    nodes = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "node_id string")
    edges = spark.createDataFrame([("e1", "a", "b"), ("e1", "b", "x"), (None, None, "y")], "edge_id string, source string, target string")
    audit = assembly.graph_audit(nodes, edges)
    assert {r.check_name: (r.n, r.status) for r in audit.collect()} == {
        "node_rows": (4, "ok"), "edge_rows": (3, "ok"), "repeated_node_ids": (1, "review"), "repeated_edge_ids": (1, "review"), "dangling_end_points": (3, "review")}
    plan = audit._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") <= 3
    assert {r.n for r in assembly.graph_audit(nodes.limit(0), edges.limit(0)).collect()} == {0}


def test_fpgrowth_reads_its_transactions_once(spark):
    asked = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda v: asked.add(1) or v, "long").asNondeterministic()
    rows = patterns.transactions(spark.range(100).select((seen("id") % 2).alias("a")), ["a"])
    assert patterns.fpgrowth_itemsets(rows).count() == 2 and asked.value == 100
