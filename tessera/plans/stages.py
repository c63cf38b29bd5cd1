"""Named stage runs: each makes the tables of one part of the analysis, writes them, and returns their manifest.

A run takes (spark, sf_dir, out) and writes Parquet tables below ``out``; later runs read nothing but
the inputs, so any of them can be repeated alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import assembly, compare, graphs, labels, models, olap, patterns, profile, sessions, warehouse
from tessera.operators.staging import staged
from tessera.plans import bindings as b
from tessera.sources import tables


def clean_core(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Trimmed and labelled measurements with stable ids, and the audits of cleaning."""
    rows = profile.strip_text(b.table(spark, sf_dir, "lineitem"))
    core = profile.stable_ids(rows, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], "measurement")
    core = staged(labels.add_labels(core.withColumn("session_id", F.col("l_orderkey").cast("string")), b.OUTCOME))
    return {"core": core, "missingness": profile.missingness(core), "label_audit": labels.label_audit(core, [*b.COMPONENTS, "degraded"])}


def star_schema(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Dimensions, the fact table and the integrity of its keys."""
    rows = staged(b.lines(spark, sf_dir, area=True, part=True))
    dims = {s.id_column: staged(warehouse.build_dimension(rows, s)) for s in b.DIMENSIONS}
    fact = staged(warehouse.build_fact(rows, b.DIMENSIONS, b.FACT))
    named = {f"dim_{s.name}": dims[s.id_column] for s in b.DIMENSIONS}
    return {**named, "fact": fact, "integrity": warehouse.integrity(fact, dims, "measurement_id"), "column_coverage": warehouse.column_coverage(rows, b.DIMENSIONS, b.FACT)}


def descriptive(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Rates, crosstabs, frequencies and key figures."""
    rows = staged(b.lines(spark, sf_dir, area=True))
    return {
        "group_rates": olap.all_group_rates(rows, b.GROUPS, "degraded"), "crosstabs": olap.crosstabs(rows, b.PAIRS, "degraded"),
        "frequencies": olap.frequencies(rows, b.GROUPS), "key_figures": olap.kpis(rows, "degraded", "session_id"),
    }


def rule_mining(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Itemsets, rules, those of the outcome, and their quality."""
    baskets = patterns.transactions(b.binned(b.lines(spark, sf_dir, area=True)), b.ITEM_COLUMNS)
    sets = staged(patterns.frequent_itemsets(baskets))
    rules = staged(patterns.association_rules(sets, 0.3))
    return {"itemsets": sets, "rules": rules, "outcome_rules": patterns.outcome_rules(rules, "degraded"), "rule_quality": patterns.rule_quality(rules)}


def comparison(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Distances between sources, summaries, and the notes of the audit."""
    long = staged(compare.long_frame(b.events(spark, sf_dir), "event_type", b.METRICS))
    distances = staged(compare.pairwise_distances(long, "click"))
    return {"distances": distances, "ranked": assembly.ranked_comparisons(distances), "summary": compare.distribution_summary(long), "notes": compare.audit_notes(long, distances, "click")}


def graph(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Nodes, edges, their audit, and the summary of contexts."""
    rows = graph_rows(spark, sf_dir)
    contexts = staged(graphs.context_nodes(rows, b.CONTEXTS, "degraded"))
    together = staged(graphs.cooccurrence(rows, b.CONTEXTS, "degraded"))
    nodes, edges = (staged(df, compression="zstd") for df in assembled(rows))
    return {"nodes": nodes, "edges": edges, "audit": assembly.graph_audit(nodes, edges), "contexts": assembly.context_summary(contexts, together), "cooccurrence": together}


def graph_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns that the graph is made of, joined once."""
    used = ["measurement_id", "session_id", *b.COMPONENTS, "degraded", *[c.column for c in b.CONTEXTS]]
    return staged(b.lines(spark, sf_dir, area=True).select(*used), compression="zstd")


def assembled(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Measurement, session and context nodes with the edges between them."""
    nodes = [assembly.measurement_nodes(rows, "measurement_id", [*b.COMPONENTS, "degraded"], "context"), assembly.session_nodes(rows, "session_id", "degraded", "context")]
    nodes.append(graphs.context_nodes(rows, b.CONTEXTS, "degraded").withColumns({"node_type": F.col("family"), "node_label": F.col("value"), "graph_view": F.lit("context")}).drop("family", "value"))
    # Rows of one measurement meet in one task, which then has all that could equal its edges: these are not dealt out again.
    held = rows.repartition("measurement_id")
    edges = [graphs.membership_edges(held.select("measurement_id", "session_id").distinct(), "measurement_id", "session_id", "context"), graphs.context_edges(held, "measurement_id", b.CONTEXTS, "context", distinct=True)]
    return assembly.assemble(nodes, edges)


def classification(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Models on a grouped split, on the latest sessions, and rules of a shallow tree."""
    rows = staged(b.lines(spark, sf_dir))
    numeric, categorical, names = ["l_quantity", "l_tax", "l_discount"], ["l_returnflag", "l_linestatus"], ["logistic_regression", "decision_tree_gini"]
    split = sessions.group_split(rows, "session_id")
    latest = rows.join(sessions.temporal_holdout(rows, "session_id", "l_shipdate").select("session_id", "is_test"), "session_id")
    run = lambda df: models.split_experiment(df, "is_test", "degraded", numeric, categorical, names)
    rules = staged(models.tree_rules(rows, "degraded", numeric))
    return {"grouped": run(split), "temporal": run(latest), "tree_rules": rules, "representative_rules": models.representative_rules(rules)}


STAGES: dict[str, Callable[[SparkSession, str], dict[str, DataFrame]]] = {
    "clean_core": clean_core, "star_schema": star_schema, "descriptive": descriptive, "rule_mining": rule_mining, "comparison": comparison, "graph": graph, "classification": classification,
}


def run(spark: SparkSession, name: str, sf_dir: str, out: str) -> DataFrame:
    """Write the tables of a stage below ``out``; the manifest has a row for each: artifact, kind, row_count."""
    made = STAGES[name](spark, sf_dir)
    written = {table: spark.read.parquet(tables.write_table(df, f"{out}/{name}/{table}", compression="zstd")) for table, df in made.items()}
    return tables.manifest(written)
