"""Queries of graph assembly, stable ids, splits, reports and stage runs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.functions import exprs
from tessera.operators import assembly, compare, graphs, models, networks, patterns, profile, sessions, staging
from tessera.plans import bindings as b
from tessera.plans import stages
from tessera.plans.mining_queries import CO, DIST, LONGC, RULES, STEPS, _co, _pairs, _rows, _rules, _steps
from tessera.sources import records, tables

L, E = f"WITH {b.LINES_SQL}", f"WITH {b.EVENTS_SQL}"
QUERIES, SQL = {}, {}


def _add(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


# Identifiers, splits and scans
_add(
    "stable_ids", lambda s, d: profile.stable_ids(b.table(s, d, "events"), ["ts", "event_id"], "event").select("event_id", "source_row_number", "measurement_id"),
    "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS source_row_number, 'event_' || lpad(row_number() OVER (ORDER BY ts, event_id)::VARCHAR, 8, '0') AS measurement_id FROM events",
)
_add(
    "nested_split", lambda s, d: sessions.nested_split(b.events(s, d), "user_id").groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users")),
    f"""{E}, u AS (SELECT DISTINCT user_id FROM e), a AS (SELECT user_id, row_number() OVER (ORDER BY md5('42||' || user_id)) <= greatest(1, round_even((SELECT count(*) FROM u) * 0.2, 0)) AS t FROM u),
    v AS (SELECT user_id, row_number() OVER (ORDER BY md5('49||' || user_id)) <= greatest(1, round_even((SELECT count(*) FROM a WHERE NOT t) * 0.2, 0)) AS v FROM a WHERE NOT t)
    SELECT CASE WHEN t THEN 'test' WHEN v THEN 'validation' ELSE 'train' END AS part, count(*) AS n, count(DISTINCT e.user_id) AS users FROM e JOIN a USING (user_id) LEFT JOIN v USING (user_id) GROUP BY 1""",
)
_add("load_tables", lambda s, d: tables.manifest(tables.load_tables(s, d, ["region", "nation", "supplier"])), "SELECT 'nation' AS artifact, 'parquet' AS kind, count(*) AS row_count FROM nation UNION ALL SELECT 'region', 'parquet', count(*) FROM region UNION ALL SELECT 'supplier', 'parquet', count(*) FROM supplier")
_add("projected_scan", lambda s, d: tables.read_parquet(s, f"{d}/customer.parquet", ["c_custkey", "c_mktsegment", "no_such_column"]).groupBy("c_mktsegment").agg(F.count("c_custkey").alias("n")), "SELECT c_mktsegment, count(c_custkey) AS n FROM customer GROUP BY 1")
_add("stripped_text", lambda s, d: profile.strip_text(b.table(s, d, "nation").withColumn("n_name", F.concat(F.lit("  "), "n_name", F.lit(" ")))).select("n_nationkey", "n_name"), "SELECT n_nationkey, n_name FROM nation")


def _csv_round_trip(s, d):
    path = tables.write_table(b.table(s, d, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment"), f"{staging.folder(s)}/csv-{uuid.uuid4().hex}", "csv")
    return tables.read_csv(s, path, "c_custkey long, c_name string, c_acctbal double, c_mktsegment string", ["c_custkey", "c_name", "c_acctbal", "absent"])


_add("csv_round_trip", _csv_round_trip, "SELECT c_custkey, c_name, c_acctbal FROM customer")
_add("csv_row_count", lambda s, d: s.range(1).select(F.lit(tables.csv_rows(s, tables.write_table(b.table(s, d, "supplier"), f"{staging.folder(s)}/csv-{uuid.uuid4().hex}", "csv"))).cast("long").alias("n")), "SELECT count(*) AS n FROM supplier")
_add(
    "column_inventory", lambda s, d: tables.column_inventory(b.table(s, d, "nation")).select("column_name", "dtype", "missing_count", "missing_fraction"),
    "SELECT 'n_nationkey' AS column_name, 'int' AS dtype, count(*) FILTER (n_nationkey IS NULL) AS missing_count, (count(*) FILTER (n_nationkey IS NULL)) / count(*) AS missing_fraction FROM nation"
    " UNION ALL SELECT 'n_name', 'string', count(*) FILTER (n_name IS NULL), (count(*) FILTER (n_name IS NULL)) / count(*) FROM nation UNION ALL SELECT 'n_regionkey', 'int', count(*) FILTER (n_regionkey IS NULL), (count(*) FILTER (n_regionkey IS NULL)) / count(*) FROM nation",
)
_add(
    "any_known", lambda s, d: tables.any_known(b.table(s, d, "documents").select("doc_id", F.when(F.col("n_chars") > 2000, F.col("n_chars")).alias("long"), F.when(F.col("lang") == "en", F.col("lang")).alias("english")), ["long", "english", "absent"]).select("doc_id"),
    "SELECT doc_id FROM documents WHERE n_chars > 2000 OR lang = 'en'",
)
_add(
    "finite_clipped", lambda s, d: b.table(s, d, "customer").select("c_custkey", exprs.finite_clipped(F.when(F.col("c_custkey") % 5 != 0, (F.col("c_acctbal") - 4500) / 300)).alias("z")),
    "SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN greatest(-8, least(8, (c_acctbal - 4500) / 300)) ELSE 0 END AS z FROM customer",
)
_add(
    "standardised_profile", lambda s, d: profile.standardised(b.table(s, d, "nation").groupBy("n_regionkey").agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("n_nationkey").alias("m")), ["n", "m"]).withColumn("m", F.round("m", 9)),
    "WITH g AS (SELECT n_regionkey, count(*)::DOUBLE AS n, avg(n_nationkey) AS m FROM nation GROUP BY 1) SELECT n_regionkey, CASE WHEN stddev_pop(n) OVER () > 0 THEN (n - avg(n) OVER ()) / stddev_pop(n) OVER () ELSE 0 END AS n, round((m - avg(m) OVER ()) / stddev_pop(m) OVER (), 9) AS m FROM g",
)
SEGMENT_ROLES = {"BUILDING": "main", "MACHINERY": "reference"}
_add(
    "label_lookup", lambda s, d: b.table(s, d, "customer").select("c_custkey", assembly.lookup("c_mktsegment", SEGMENT_ROLES, F.lit("other")).alias("role")),
    "SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'main' WHEN 'MACHINERY' THEN 'reference' ELSE 'other' END AS role FROM customer",
)
_add(
    "scenario_names", lambda s, d: b.table(s, d, "events").select("event_id", tables.scenario(F.when(F.col("event_id") % 3 == 0, "given"), F.when(F.col("event_id") % 3 == 1, "low"), F.lit("tdma"), F.col("event_id") % 7, F.lit("runs/folder/file.csv")).alias("scenario")),
    "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'given' WHEN 1 THEN 'low_tdma_seed_' || (event_id % 7) ELSE 'folder' END AS scenario FROM events",
)
_add(
    "path_levels", lambda s, d: b.table(s, d, "nation").select("n_nationkey", tables.path_parts(F.concat(F.lit("file:/data/raw/"), F.lower("n_name"), F.lit("/static/run one/x.csv")), "raw").alias("p")).select("n_nationkey", F.col("p")[0].alias("app"), F.col("p")[1].alias("mobility"), F.col("p")[2].alias("scenario")),
    "SELECT n_nationkey, lower(n_name) AS app, 'static' AS mobility, 'run one' AS scenario FROM nation",
)
_add(
    "metric_support", lambda s, d: compare.metric_support(stages_long(s, d)),
    f"{E}, l AS (SELECT event_type AS source, 'value' AS metric, value FROM e UNION ALL SELECT event_type, 'k', k::DOUBLE FROM e), g AS (SELECT metric, source, count(*) AS n FROM l GROUP BY 1, 2) SELECT metric, count(DISTINCT source) AS sources, sum(n)::BIGINT AS values, count(*) FILTER (n >= 1000) AS main_text_sources FROM g GROUP BY 1",
)


def stages_long(s, d):
    long = compare.long_frame(b.events(s, d), "event_type", b.METRICS)
    return long.groupBy("metric", "source").agg(F.count(F.lit(1)).alias("n")).withColumn("recommended_use", F.when(F.col("n") >= 1000, "main_text").otherwise("appendix"))


# Rules
_add(
    "algorithm_labels", lambda s, d: patterns.merge_algorithms(
        (lambda r: r.select(patterns.to_text("antecedent").alias("antecedent"), patterns.to_text("consequent").alias("consequent"), F.round("lift", 7).alias("lift"), F.explode(F.when(F.col("lift") >= 1, F.array(F.lit("fpgrowth"), F.lit("apriori"))).otherwise(F.array(F.lit("apriori")))).alias("algorithm")))(_rules(s, d))),
    f"{RULES} SELECT antecedent, consequent, CASE WHEN confidence / sc >= 1 THEN 'apriori;fpgrowth' ELSE 'apriori' END AS algorithms, round(confidence / sc, 7) AS lift FROM rules",
)
NUMERIC = ["l_quantity", "l_tax", "l_discount"]
_add("tree_rule_report", lambda s, d: models.rules_text(models.tree_rules(b.lines(s, d), "degraded", NUMERIC), "outcome"))
_add("ranked_comparisons", lambda s, d: assembly.ranked_comparisons(_pairs(s, d)).select("metric", "reference", "ks", "wasserstein"), f"{DIST} SELECT metric, reference, ks, wasserstein FROM k WHERE ks IS NOT NULL")

# Graph tables
FLAGS = ", ".join(f"max({c})::INT AS {c}" for c in [*b.COMPONENTS, "degraded"])
_add("measurement_nodes", lambda s, d: assembly.measurement_nodes(b.lines(s, d), "measurement_id", [*b.COMPONENTS, "degraded", "absent"]), f"{L} SELECT measurement_id AS node_id, 'measurement' AS node_type, measurement_id AS node_label, 'warehouse' AS graph_view, {FLAGS} FROM d GROUP BY 1, 3")
_add(
    "session_nodes", lambda s, d: assembly.session_nodes(b.lines(s, d), "session_id", "degraded"),
    f"{L} SELECT 'warehouse:session:' || session_id || ':' || substr(sha1(session_id), 1, 12) AS node_id, 'session' AS node_type, session_id AS node_label, 'warehouse' AS graph_view, count(*) AS row_count, sum(degraded)::BIGINT AS outcome_count, sum(degraded)::BIGINT / count(*) AS outcome_rate FROM d GROUP BY session_id",
)
_add(
    "graph_audit", lambda s, d: assembly.graph_audit(*stages.assembled(stages.graph_rows(s, d))),
    f"""{L}, {LONGC}, mm AS (SELECT count(DISTINCT measurement_id) AS m, count(DISTINCT session_id) AS ss, count(DISTINCT measurement_id || '|' || session_id) AS me FROM d), x AS (SELECT count(DISTINCT node_id) AS n, count(DISTINCT measurement_id || '|' || node_id) AS e FROM c)
    SELECT 'node_rows' AS check_name, m + ss + n AS n, 'ok' AS status FROM mm, x UNION ALL SELECT 'edge_rows', me + e, 'ok' FROM mm, x UNION ALL SELECT unnest(['repeated_node_ids', 'repeated_edge_ids', 'dangling_end_points']), 0, 'ok'""",
)
_add(
    "context_summary", lambda s, d: assembly.context_summary(graphs.context_nodes(_rows(s, d), b.CONTEXTS, "degraded").select("node_id", "family"), _co(s, d)),
    f"{CO}, en AS (SELECT source AS node_id, row_count, lift FROM co UNION ALL SELECT target, row_count, lift FROM co) SELECT node_id, split_part(node_id, ':', 2) AS family, count(*) AS incident_edges, sum(row_count)::BIGINT AS incident_rows, max(lift) AS max_lift FROM en GROUP BY 1",
)
VIEW_ROLES = {"warehouse": "order of measurements", "context": "values that occur together", "evidence": "comparisons of sources"}
_add(
    "scope_table",
    lambda s, d: assembly.scope_table(graphs.view_summary(graphs.context_nodes(_rows(s, d), b.CONTEXTS, "degraded").withColumn("graph_view", F.lit("context")), _co(s, d).withColumn("graph_view", F.lit("context")).unionByName(_steps(s, d).withColumn("graph_view", F.lit("warehouse")), allowMissingColumns=True)), VIEW_ROLES),
    f"{CO}, {LONGC.replace('c AS', 'cc AS', 1)}, {b.EVENTS_SQL}, tr AS ({STEPS}) SELECT 0 AS position, 'warehouse' AS graph_view, 'order of measurements' AS role, 0 AS nodes, (SELECT count(*) FROM tr) AS edges"
    " UNION ALL SELECT 1, 'context', 'values that occur together', (SELECT count(DISTINCT node_id) FROM cc), (SELECT count(*) FROM co) UNION ALL SELECT 2, 'evidence', 'comparisons of sources', 0, 0",
)
_add(
    "degree_features", lambda s, d: assembly.degree_features(b.events(s, d).select(F.col("event_id").alias("node_id")), _steps(s, d), b.events(s, d).select(F.col("event_id").alias("source"), (-1 - F.col("user_id")).alias("target"))),
    f"{E}, t AS ({STEPS}) SELECT event_id AS node_id, coalesce(i, 0) AS transition_in, coalesce(o, 0) AS transition_out, 1 + coalesce(i, 0) + coalesce(o, 0) AS total_degree FROM e LEFT JOIN (SELECT target, count(*) AS i FROM t GROUP BY 1) a ON a.target = event_id LEFT JOIN (SELECT source, count(*) AS o FROM t GROUP BY 1) b ON b.source = event_id",
)

# Stage runs: the manifest of what each has written
def _stage(name):
    return lambda s, d: stages.run(s, name, d, f"{staging.folder(s)}/stage-{uuid.uuid4().hex}")


_add("stage_clean_core", _stage("clean_core"))
_add(
    "stage_descriptive", _stage("descriptive"),
    f"{L} SELECT 'group_rates' AS artifact, 'parquet' AS kind, (" + " + ".join(f"(SELECT count(*) FROM (SELECT DISTINCT {c} FROM d))" for c in b.GROUPS) + ") AS row_count UNION ALL SELECT 'frequencies', 'parquet', (" + " + ".join(f"(SELECT count(*) FROM (SELECT DISTINCT {c} FROM d))" for c in b.GROUPS)
    + ") UNION ALL SELECT 'crosstabs', 'parquet', (" + " + ".join(f"(SELECT count(*) FROM (SELECT DISTINCT {x}, {y} FROM d))" for x, y in b.PAIRS) + ") UNION ALL SELECT 'key_figures', 'parquet', 4",
)
_add("stage_star_schema", _stage("star_schema"))
_add("stage_rule_mining", _stage("rule_mining"), f"{RULES} SELECT 'itemsets' AS artifact, 'parquet' AS kind, (SELECT count(*) FROM sets, need) AS row_count UNION ALL SELECT 'rules', 'parquet', (SELECT count(*) FROM rules) UNION ALL SELECT 'outcome_rules', 'parquet', (SELECT count(*) FROM rules WHERE consequent = 'degraded=1' AND NOT contains(antecedent, 'degraded=')) UNION ALL SELECT 'rule_quality', 'parquet', 1")
_add("stage_comparison", _stage("comparison"))
_add("stage_graph", _stage("graph"))
_add("stage_classification", _stage("classification"))


def _networks(s, d):
    """Events of a user form a chain; what an event's neighbours did tells its outcome."""
    rows = sessions.nested_split(b.events(s, d), "user_id")
    kinds = {f"is_{t}": (F.col("event_type") == t).cast("int") for t in ("click", "view", "purchase", "error")}
    nodes = rows.select(F.col("event_id").alias("node_id"), F.col("user_id").alias("group"), "part", F.col("degraded").alias("y"), "k", *[c.alias(n) for n, c in kinds.items()])
    return networks.graph_networks(nodes, _steps(s, d), ["k", *kinds])


_add("graph_networks", _networks)


# Types and files
def _stringified(s, d):
    c = b.table(s, d, "customer")
    return c.select(F.col("c_custkey").cast("string").alias("key"), "c_name", F.concat(F.lit(" "), F.col("c_acctbal").cast("string")).alias("balance"), (F.col("c_custkey") % 2 == 0).cast("string").alias("even"), F.col("c_nationkey").cast("double").alias("nation"), F.lit(None).cast("string").alias("nothing"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_custkey") % 3).cast("string").alias("gaps"))


_add(
    "inferred_types", lambda s, d: profile.inferred_types(_stringified(s, d)),
    "SELECT 'key' AS column_name, 'string' AS source_type, 'bigint' AS inferred_type, count(*) AS non_null FROM customer UNION ALL SELECT 'c_name', 'string', 'string', count(*) FROM customer UNION ALL SELECT 'balance', 'string', 'double', count(*) FROM customer UNION ALL SELECT 'even', 'string', 'boolean', count(*) FROM customer"
    " UNION ALL SELECT 'nation', 'double', 'bigint', count(*) FROM customer UNION ALL SELECT 'nothing', 'string', 'string', 0 FROM customer GROUP BY 1 UNION ALL SELECT 'gaps', 'string', 'bigint', count(*) FILTER (c_custkey % 3 > 0) FROM customer",
)
_add(
    "converted_totals", lambda s, d: profile.converted(_stringified(s, d)).groupBy("even").agg(F.sum("key").alias("keys"), F.round(F.sum("balance"), 4).alias("balance"), F.sum("nation").alias("nations"), F.sum("gaps").alias("gaps"), F.count("nothing").alias("nothing")),
    "SELECT c_custkey % 2 = 0 AS even, sum(c_custkey)::BIGINT AS keys, round(sum(c_acctbal), 4) AS balance, sum(c_nationkey)::BIGINT AS nations, sum(c_custkey % 3)::BIGINT AS gaps, 0::BIGINT AS nothing FROM customer GROUP BY 1",
)


def _csv_with_breaks(s, d):
    rows = b.table(s, d, "customer").select("c_custkey", F.concat("c_name", F.lit('\n"a" quote,\n'), "c_mktsegment").alias("c_text"), "c_acctbal")
    return tables.write_table(rows.coalesce(1), f"{staging.folder(s)}/csv-{uuid.uuid4().hex}", "csv")


_add("csv_records", lambda s, d: records.csv_records(s, _csv_with_breaks(s, d)).select("records"), "SELECT count(*) + 1 AS records FROM customer")


def _raw_audit(s, d):
    at = f"{staging.folder(s)}/raw-{uuid.uuid4().hex}"
    tables.write_table(b.table(s, d, "nation").coalesce(1), f"{at}/nation", "csv")
    tables.write_table(b.table(s, d, "region").coalesce(1), f"{at}/region")
    audit = tables.raw_audit(s, {"nation": f"{at}/nation", "region": f"{at}/region", "absent": f"{at}/absent"})
    counted = F.when(F.col("dataset") == "nation", F.lit(tables.csv_rows(s, f"{at}/nation"))).cast("long")
    return audit.select("dataset", "exists", "tables", "status", counted.alias("csv_rows"))


_add("raw_audit", _raw_audit, "SELECT 'nation' AS dataset, true AS \"exists\", 1::BIGINT AS tables, 'ok' AS status, count(*) AS csv_rows FROM nation UNION ALL SELECT 'region', true, 1, 'ok', NULL UNION ALL SELECT 'absent', false, 0, 'missing', NULL")
