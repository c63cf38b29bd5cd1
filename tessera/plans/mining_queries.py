"""Session, split, pattern, comparison and graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import compare, graphs, patterns, sessions, staging
from tessera.plans import bindings as b
from tessera.plans.specs import MetricSpec
from tessera.plans.warehouse_queries import RATE
from tessera.sources import tables
from tessera.streaming import events as streams
from tessera.streaming import sessions as open_sessions

L, E = f"WITH {b.LINES_SQL}", f"WITH {b.EVENTS_SQL}"
QUERIES, SQL = {}, {}
FILTERED = [MetricSpec("quantity", "l_quantity", {"R": "O"})]


def _add(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


# Sessions
_add(
    "session_steps", lambda s, d: sessions.step_index(b.events(s, d), "user_id", ["ts", "event_id"]).select("event_id", "user_id", "session_step_index", "session_record_count"),
    f"{E} SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INT AS session_step_index, count(*) OVER (PARTITION BY user_id) AS session_record_count FROM e",
)
STEPS = "SELECT user_id, event_id AS source, lead(event_id) OVER w AS target, degraded AS source_state, lead(degraded) OVER w AS target_state FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id) QUALIFY target IS NOT NULL"


def _steps(s, d):
    return sessions.transitions(b.events(s, d), "user_id", ["ts", "event_id"], "event_id", "degraded")


_add("transition_edges", _steps, f"{E} {STEPS}")
_add(
    "stream_transition_edges", lambda s, d: open_sessions.replayed(s, open_sessions.session_transitions(b.event_stream(s, d), "user_id", "ts", "event_id", "degraded", watermark="0 seconds")),
    f"{E} {STEPS}",
)
_add("transition_matrix", lambda s, d: sessions.transition_matrix(_steps(s, d)), f"{E}, t AS ({STEPS}) SELECT source_state, target_state, count(*) AS n, count(*) / (SELECT count(*) FROM t) AS fraction FROM t GROUP BY 1, 2")
_add("session_rates", lambda s, d: sessions.session_rates(b.lines(s, d), "session_id", "degraded"), f"{L} SELECT session_id, {RATE} FROM d GROUP BY 1")
_add(
    "session_profile", lambda s, d: sessions.session_profile(b.lines(s, d), "session_id", ["l_quantity"], ["l_returnflag", "l_linestatus"]).withColumn("l_quantity", F.round("l_quantity", 6)),
    f"""{L}, c AS (SELECT session_id, l_returnflag AS v, count(*) AS n FROM d GROUP BY 1, 2), c2 AS (SELECT session_id, l_linestatus AS v, count(*) AS n FROM d GROUP BY 1, 2)
    SELECT session_id, count(*) AS record_count, round(avg(l_quantity), 6) AS l_quantity,
      (SELECT v FROM c WHERE c.session_id = d.session_id ORDER BY n DESC, v LIMIT 1) AS l_returnflag, (SELECT v FROM c2 WHERE c2.session_id = d.session_id ORDER BY n DESC, v LIMIT 1) AS l_linestatus FROM d GROUP BY session_id""",
)
_add(
    "temporal_holdout", lambda s, d: sessions.temporal_holdout(b.events(s, d), "user_id", "ts").select("user_id", F.col("is_test").cast("int").alias("is_test")),
    f"{E}, st AS (SELECT user_id, min(ts) AS start FROM e GROUP BY 1) SELECT user_id, (row_number() OVER (ORDER BY start DESC, user_id DESC) <= greatest(1, round_even((SELECT count(*) FROM st) * 0.2, 0)))::INT AS is_test FROM st",
)
_add(
    "hash_group_split", lambda s, d: sessions.group_split(b.lines(s, d), "session_id").groupBy(F.col("is_test").cast("int").alias("is_test")).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("session_id").alias("groups")),
    f"""{L}, g AS (SELECT session_id, row_number() OVER (ORDER BY md5('42||' || session_id)) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT session_id FROM d))
    SELECT (r <= greatest(1, round_even(n * 0.2, 0)))::INT AS is_test, count(*) AS rows, count(DISTINCT d.session_id) AS groups FROM d JOIN g USING (session_id) GROUP BY 1""",
)
_add(
    "stratified_cap", lambda s, d: sessions.stratified_cap(b.events(s, d), "event_type", "event_id", 1000).select("event_id", "event_type"),
    f"""{E}, r AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY md5('42||' || event_id), event_id) AS r, count(*) OVER (PARTITION BY event_type) AS c, count(*) OVER () AS n FROM e)
    SELECT event_id, event_type FROM r WHERE r <= CASE WHEN n <= 1000 THEN c ELSE floor(1000 * c / n) END""",
)
_add("sample_rows", lambda s, d: sessions.sample_rows(b.events(s, d), "event_id", 200).select("event_id", "value"), f"{E} SELECT event_id, value FROM e ORDER BY md5('42||' || event_id), event_id LIMIT 200")
_add(
    "split_audit",
    lambda s, d: sessions.split_audit(_steps(s, d), b.events(s, d).select(F.col("event_id").alias("node"), (F.col("k") % 5 == 0).alias("is_test"))),
    f"{E}, t AS ({STEPS}) SELECT CASE WHEN (a.k % 5 = 0) <> (c.k % 5 = 0) THEN 'across' WHEN a.k % 5 = 0 THEN 'test' ELSE 'train' END AS part, count(*) AS edges FROM t JOIN e a ON a.event_id = source JOIN e c ON c.event_id = target GROUP BY 1",
)


# Patterns
def _transactions(s, d):
    return patterns.transactions(b.binned(b.lines(s, d, area=True)), b.ITEM_COLUMNS, ["measurement_id"])


ITEMS = "list_sort([" + ", ".join(f"'{c.removesuffix('_bin')}=' || translate(trim({c}::VARCHAR), ' ;,', '___')" for c in b.ITEM_COLUMNS) + "])"
# Rows are told apart by a number of their own, as measurement ids may repeat.
T = f"{L}, t AS (SELECT measurement_id, row_number() OVER () AS rid, {ITEMS} AS items FROM d)"
_add("transactions", lambda s, d: _transactions(s, d).select("measurement_id", patterns.to_text("items").alias("transaction")), f"{T} SELECT measurement_id, array_to_string(items, ';') AS transaction FROM t")
_add(
    "item_support", lambda s, d: patterns.item_support(_transactions(s, d)),
    f"{T}, i AS (SELECT unnest(items) AS item FROM t) SELECT item, split_part(item, '=', 1) AS family, substr(item, instr(item, '=') + 1) AS value, count(*) AS n, count(*) / (SELECT count(*) FROM t) AS support FROM i GROUP BY 1",
)
SETS = f"""{T}, i AS (SELECT rid, unnest(items) AS x FROM t), need AS (SELECT ceil(round(0.05 * count(*), 6)) AS need, count(*) AS total FROM t),
s1 AS MATERIALIZED (SELECT x, count(*) AS n FROM i GROUP BY 1 HAVING count(*) >= (SELECT need FROM need)),
u AS MATERIALIZED (SELECT s, count(*) AS copies, row_number() OVER () AS rid FROM (SELECT list(x ORDER BY x) AS s FROM i SEMI JOIN s1 USING (x) GROUP BY rid) GROUP BY s), j AS MATERIALIZED (SELECT rid, copies, unnest(s) AS x FROM u),
s2 AS MATERIALIZED (SELECT a.x AS x, b.x AS y, sum(a.copies)::BIGINT AS n FROM j a JOIN j b ON a.rid = b.rid AND a.x < b.x GROUP BY 1, 2 HAVING sum(a.copies) >= (SELECT need FROM need)),
s3 AS MATERIALIZED (SELECT a.x AS x, b.x AS y, c.x AS z, sum(a.copies)::BIGINT AS n FROM j a JOIN j b ON a.rid = b.rid AND a.x < b.x JOIN j c ON b.rid = c.rid AND b.x < c.x GROUP BY 1, 2, 3 HAVING sum(a.copies) >= (SELECT need FROM need)),
sets AS (SELECT [x] AS itemset, 1 AS size, n FROM s1 UNION ALL SELECT [x, y], 2, n FROM s2 UNION ALL SELECT [x, y, z], 3, n FROM s3)"""


def _sets(s, d):
    return patterns.frequent_itemsets(_transactions(s, d))


def _shown(df):
    return df.withColumn("itemset", patterns.to_text("itemset"))


_add("frequent_pairs", lambda s, d: _shown(patterns.frequent_itemsets(_transactions(s, d), max_length=2).where("size = 2")), f"{SETS} SELECT array_to_string(itemset, ';') AS itemset, size, n, n / total AS support FROM sets, need WHERE size = 2")
_add("frequent_triples", lambda s, d: _shown(_sets(s, d).where("size = 3")), f"{SETS} SELECT array_to_string(itemset, ';') AS itemset, size, n, n / total AS support FROM sets, need WHERE size = 3")
_add("fpgrowth_itemsets", lambda s, d: _shown(patterns.fpgrowth_itemsets(_transactions(s, d))), f"{SETS} SELECT array_to_string(itemset, ';') AS itemset, size, n, n / total AS support FROM sets, need")
RULES = f"""{SETS}, p AS MATERIALIZED (SELECT itemset, n / total AS support FROM sets, need), mk AS (SELECT itemset, support, unnest(range(1, (1 << len(itemset)) - 1)) AS mask FROM p WHERE len(itemset) > 1),
sp AS (SELECT support, list_filter(itemset, lambda x, i: (mask >> (i - 1)) & 1 = 1) AS a, list_filter(itemset, lambda x, i: (mask >> (i - 1)) & 1 = 0) AS c FROM mk),
rules AS (SELECT array_to_string(a, ';') AS antecedent, array_to_string(c, ';') AS consequent, pa.support AS sa, pc.support AS sc, sp.support AS support, sp.support / pa.support AS confidence FROM sp JOIN p pa ON pa.itemset = a JOIN p pc ON pc.itemset = c WHERE sp.support / pa.support >= 0.3)"""


def _rules(s, d):
    # Two supports of the same itemsets are joined with the splits; the table is small and would be computed three times over.
    return patterns.association_rules(staging.staged(_sets(s, d)), 0.3)


def _rule_columns(df):
    return df.select(patterns.to_text("antecedent").alias("antecedent"), patterns.to_text("consequent").alias("consequent"), "support", "confidence", *[F.round(c, 7).alias(c) for c in ("lift", "leverage", "conviction")])


RULE_COLUMNS = "antecedent, consequent, support, confidence, round(confidence / sc, 7) AS lift, round(support - sa * sc, 7) AS leverage, CASE WHEN confidence >= 1 THEN 'inf'::DOUBLE ELSE round((1 - sc) / (1 - confidence), 7) END AS conviction"
_add("association_rules", lambda s, d: _rule_columns(_rules(s, d)), f"{RULES} SELECT {RULE_COLUMNS} FROM rules")
_add(
    "degradation_rules", lambda s, d: _rule_columns(patterns.outcome_rules(_rules(s, d), "degraded", ["l_quantity"])),
    f"{RULES} SELECT {RULE_COLUMNS} FROM rules WHERE consequent = 'degraded=1' AND NOT regexp_matches(antecedent, '(^|;)(degraded|l_quantity)=')",
)
_add(
    "top_rules", lambda s, d: patterns.rank_rules(patterns.outcome_rules(_rules(s, d), "degraded"), 20).select("rule_id", "antecedent_text", F.round("lift", 7).alias("lift")),
    f"{RULES} SELECT 'R' || row_number() OVER w AS rule_id, antecedent AS antecedent_text, round(confidence / sc, 7) AS lift FROM rules WHERE consequent = 'degraded=1' AND NOT contains(antecedent, 'degraded=') WINDOW w AS (ORDER BY round(confidence / sc, 9) DESC, round(confidence, 9) DESC, round(support, 9) DESC, antecedent, consequent) QUALIFY row_number() OVER w <= 20",
)
_add(
    "rule_quality", lambda s, d: (lambda q: q.select(*[F.round(c, 7).alias(c) if c != "rule_count" else F.col(c) for c in q.columns]))(patterns.rule_quality(_rules(s, d))),
    f"{RULES} SELECT count(*) AS rule_count, " + ", ".join(f"round({f}({e}), 7) AS {n}_{m}" for m, e in (("lift", "confidence / sc"), ("confidence", "confidence"), ("support", "support")) for n, f in (("min", "min"), ("median", "median"), ("max", "max"))) + " FROM rules",
)
_add(
    "transaction_checks", lambda s, d: patterns.validate_transactions(_transactions(s, d), "degraded"),
    f"{T} SELECT count(*) AS row_count, count(*) FILTER (len(items) = 0) AS empty_count, count(*) FILTER (len(list_filter(items, lambda i: starts_with(i, 'degraded='))) <> 1) AS without_one_outcome FROM t",
)


# Comparison of sources
def _frame(s, d):
    return compare.long_frame(b.events(s, d), "event_type", [MetricSpec("value", "value"), MetricSpec("k", "k")])


LONG = f"{E}, l AS (SELECT event_type AS source, 'value' AS metric, value FROM e UNION ALL SELECT event_type, 'k', k::DOUBLE FROM e)"
_add("long_frame", lambda s, d: _frame(s, d).groupBy("source", "metric").agg(F.count(F.lit(1)).alias("n")), f"{LONG} SELECT source, metric, count(value) AS n FROM l GROUP BY 1, 2")
_add(
    "context_filtered_frame", lambda s, d: compare.long_frame(b.lines(s, d, order=True), "l_returnflag", [MetricSpec("quantity", "l_quantity", {"R": "O"})], "o_orderstatus").groupBy("source").agg(F.count(F.lit(1)).alias("n")),
    f"{L} SELECT l_returnflag AS source, count(*) AS n FROM d WHERE l_returnflag <> 'R' OR o_orderstatus = 'O' GROUP BY 1",
)
_add(
    "distribution_summary", lambda s, d: compare.distribution_summary(_frame(s, d)),
    f"{LONG} SELECT source, metric, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, min(value) AS min, " + ", ".join(f"round(quantile_cont(value, {q}), 9) AS {n}" for n, q in compare.QUANTILES.items()) + ", max(value) AS max, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 9) AS iqr FROM l GROUP BY 1, 2",
)
_add(
    "coverage", lambda s, d: compare.coverage(b.table(s, d, "documents").withColumn("long_text", F.when(F.col("n_chars") > 1000, F.col("n_chars"))), "source", ["text", "long_text"]),
    "SELECT source, count(*) AS row_count, count(text) AS text_n, count(*) FILTER (n_chars > 1000) AS long_text_n, count(text) / count(*) AS text_fraction, (count(*) FILTER (n_chars > 1000)) / count(*) AS long_text_fraction FROM documents GROUP BY 1",
)
_add("context_coverage", lambda s, d: compare.context_coverage(b.lines(s, d, order=True), ["l_returnflag", "o_orderstatus"]), f"{L} SELECT l_returnflag, o_orderstatus, count(*) AS row_count FROM d GROUP BY 1, 2")
SOURCES = ["click", "view", "purchase", "error", "signup", "absent"]
_add(
    "readiness", lambda s, d: compare.readiness(_frame(s, d), "click", SOURCES, ["value", "k"], 2000),
    f"{LONG}, g AS (SELECT m.x AS metric, s.x AS source FROM (SELECT unnest(['value', 'k']) AS x) m, (SELECT unnest({SOURCES}) AS x) s), c AS (SELECT metric, source, count(*) AS n FROM l GROUP BY 1, 2)"
    " SELECT g.metric, g.source, coalesce(c.n, 0) AS n, CASE WHEN coalesce(c.n, 0) = 0 THEN 'missing' WHEN c.n < 2000 THEN 'insufficient' WHEN g.source = 'click' THEN 'available' WHEN coalesce(mn.n, 0) < 2000 THEN 'reference_only' ELSE 'pairwise_comparable' END AS status FROM g LEFT JOIN c USING (metric, source) LEFT JOIN c mn ON mn.metric = g.metric AND mn.source = 'click'",
)
_pairs = lambda s, d: compare.pairwise_distances(_frame(s, d), "click")
DIST = f"""{LONG}, v AS (SELECT r.metric, r.source AS reference, p.value, (SELECT count(*) FROM l x WHERE x.metric = r.metric AND x.source = 'click') AS na, (SELECT count(*) FROM l x WHERE x.metric = r.metric AND x.source = r.source) AS nb,
  count(*) FILTER (p.source = 'click') AS a, count(*) FILTER (p.source = r.source) AS b FROM (SELECT DISTINCT metric, source FROM l WHERE source <> 'click') r JOIN l p ON p.metric = r.metric AND p.source IN ('click', r.source) GROUP BY r.metric, r.source, p.value),
q AS (SELECT *, sum(a) OVER w / na AS fa, sum(b) OVER w / nb AS fb, lead(value) OVER w AS nv FROM v WINDOW w AS (PARTITION BY metric, reference ORDER BY value)),
k AS (SELECT metric, reference, max(na) AS n_main, max(nb) AS n_reference, round(max(abs(fa - fb)), 9) AS ks, round(sum(abs(fa - fb) * (nv - value)), 6) AS wasserstein FROM q GROUP BY 1, 2),
md AS (SELECT metric, source, quantile_cont(value, 0.5) AS m FROM l GROUP BY 1, 2)"""
_add("ks_distance", lambda s, d: _pairs(s, d).select("metric", "reference", "n_main", "n_reference", "ks"), f"{DIST} SELECT metric, reference, n_main, n_reference, ks FROM k")
_add("wasserstein_distance", lambda s, d: _pairs(s, d).select("metric", "reference", "wasserstein"), f"{DIST} SELECT metric, reference, wasserstein FROM k")
_add(
    "pairwise_distance", _pairs,
    f"{DIST} SELECT k.*, a.m AS median_main, r.m AS median_reference, round(a.m - r.m, 9) AS median_difference, CASE WHEN r.m <> 0 THEN round(a.m / r.m, 9) END AS median_ratio FROM k JOIN md a ON a.metric = k.metric AND a.source = 'click' JOIN md r ON r.metric = k.metric AND r.source = k.reference",
)
_add("ks_p_value", lambda s, d: _pairs(s, d).select("metric", "reference", F.round(compare.ks_p_value("ks", "n_main", "n_reference"), 6).alias("p_value")))


# Graph
def _rows(s, d):
    return b.lines(s, d, area=True)


_node = lambda f, c: f"'context:{f}:' || substr(trim(regexp_replace(regexp_replace(lower({c}), '[\\s/\\\\:;,|()\\[\\]]+', '_', 'g'), '_+', '_', 'g'), '_'), 1, 70) || ':' || substr(sha1({c}), 1, 12)"
LONGC = "c AS (" + " UNION ALL ".join(f"SELECT measurement_id, '{x.family}' AS family, {x.column} AS value, {_node(x.family, x.column)} AS node_id, degraded FROM d" for x in b.CONTEXTS) + ")"
_add("context_nodes", lambda s, d: graphs.context_nodes(_rows(s, d), b.CONTEXTS, "degraded"), f"{L}, {LONGC} SELECT node_id, family, value, {RATE} FROM c GROUP BY 1, 2, 3")
_add(
    "context_edges", lambda s, d: graphs.context_edges(_rows(s, d), "measurement_id", b.CONTEXTS, "context").groupBy("target", "edge_type").agg(F.count(F.lit(1)).alias("n"), F.min("edge_id").alias("least_id")),
    f"{L}, {LONGC} SELECT node_id AS target, 'has_' || family AS edge_type, count(*) AS n, min('edge_' || substr(sha1('context||has_context||' || measurement_id || '||' || node_id), 1, 18)) AS least_id FROM c GROUP BY 1, 2",
)
_add("membership_edges", lambda s, d: graphs.membership_edges(b.lines(s, d), "measurement_id", "session_id").groupBy("target").agg(F.count(F.lit(1)).alias("n")), f"{L} SELECT 'warehouse:session:' || session_id || ':' || substr(sha1(session_id), 1, 12) AS target, count(*) AS n FROM d GROUP BY 1")
# Rows are told apart by a number of their own, as measurement ids may repeat.
CO = f"""{L}, r AS (SELECT *, row_number() OVER () AS rid FROM d), c AS ({' UNION ALL '.join(f"SELECT rid, '{x.family}' AS family, {_node(x.family, x.column)} AS node_id, degraded FROM r" for x in b.CONTEXTS)}),
g AS (SELECT x.node_id AS source, y.node_id AS target, {RATE.replace('degraded', 'x.degraded')} FROM c x JOIN c y ON x.rid = y.rid AND x.family < y.family GROUP BY 1, 2),
t AS (SELECT sum(degraded)::BIGINT / count(*) AS base, count(*) AS n FROM d), co AS (SELECT g.*, base AS baseline_rate, outcome_rate / base AS lift, row_count / t.n AS support FROM g, t)"""


def _co(s, d):
    return graphs.cooccurrence(_rows(s, d), b.CONTEXTS, "degraded")


_add("cooccurrence_lift", _co, f"{CO} SELECT * FROM co")
_add("high_lift_edges", lambda s, d: graphs.high_lift_edges(_co(s, d)), f"{CO} SELECT * FROM co WHERE row_count >= (SELECT greatest(25, floor(quantile_cont(row_count, 0.25))) FROM co) AND lift >= 1 ORDER BY lift DESC, outcome_rate DESC, row_count DESC, source, target LIMIT 100")


def _ranked(s, d):
    co, nodes = _co(s, d), graphs.context_nodes(_rows(s, d), b.CONTEXTS, "degraded").select("node_id", "family")
    return graphs.degrees(nodes, co, F.col("row_count"))


DEG = f"{CO}, ends AS (SELECT source AS node_id, row_count FROM co UNION ALL SELECT target, row_count FROM co), dg AS (SELECT node_id, split_part(node_id, ':', 2) AS family, count(*) AS degree, sum(row_count)::DOUBLE AS weighted_degree FROM ends GROUP BY 1)"
_add("degree_summary", _ranked, f"{DEG} SELECT * FROM dg")
_add("top_nodes_by_view", lambda s, d: graphs.top_nodes(_ranked(s, d), "family", 3), f"{DEG} SELECT *, row_number() OVER (PARTITION BY family ORDER BY weighted_degree DESC, degree DESC, node_id)::INT AS rank FROM dg QUALIFY rank <= 3")
_add(
    "dangling_endpoints", lambda s, d: graphs.dangling(b.events(s, d).where("k < 50").select(F.col("event_id").alias("node_id")), _steps(s, d)),
    f"{E}, t AS ({STEPS}) SELECT DISTINCT x AS node_id FROM (SELECT source AS x FROM t UNION ALL SELECT target FROM t) WHERE x NOT IN (SELECT event_id FROM e WHERE k < 50)",
)
_add("duplicate_ids", lambda s, d: graphs.duplicate_ids(b.lines(s, d).withColumn("id", F.concat_ws("-", "l_orderkey", "l_linenumber")), "id"), f"{L} SELECT l_orderkey || '-' || l_linenumber AS id, count(*) AS n FROM d GROUP BY 1 HAVING count(*) > 1")
_add(
    "edge_type_pivot", lambda s, d: graphs.pivot_contexts(graphs.context_edges(b.lines(s, d), "measurement_id", b.CONTEXTS, "context"), ["has_network", "has_status"]),
    f"{L} SELECT measurement_id AS source, min({_node('network', 'l_returnflag')}) AS has_network, min({_node('status', 'l_linestatus')}) AS has_status FROM d GROUP BY 1",
)
_add(
    "target_rate_encoding", lambda s, d: graphs.target_rates(b.events(s, d).select("event_id", "event_type", "degraded", (F.col("k") >= 80).alias("is_test")), "event_type", "degraded", "is_test").select("event_id", "target_rate"),
    f"{E}, r AS (SELECT event_type, sum(degraded)::BIGINT / count(*) AS rate FROM e WHERE k < 80 GROUP BY 1) SELECT event_id, coalesce(rate, (SELECT sum(degraded)::BIGINT / count(*) FROM e WHERE k < 80)) AS target_rate FROM e LEFT JOIN r USING (event_type)",
)
_add(
    "neighbor_mean", lambda s, d: graphs.neighbour_mean(b.events(s, d).select(F.col("event_id").alias("node_id"), "value"), _steps(s, d), ["value"], 1).withColumn("value", F.round("value", 6)),
    f"{E}, t AS ({STEPS}), h AS (SELECT source AS a, target AS b FROM t UNION SELECT target, source FROM t UNION SELECT event_id, event_id FROM e) SELECT a AS node_id, round(avg(value), 6) AS value FROM h JOIN e ON e.event_id = h.b GROUP BY 1",
)
def _whole_bipartite(s, d):
    """Every user and every k as a node, every event that names both as a link."""
    ends = b.events(s, d).select(F.concat(F.lit("u"), "user_id").alias("source"), F.concat(F.lit("k"), "k").alias("target")).distinct()
    return ends.select(F.explode(F.array("source", "target")).alias("node_id")).dropna().distinct(), ends.dropna()


# No SQL: the recursive closure of the whole graph is quadratic there.
_add("connected_components", lambda s, d: graphs.components(*_whole_bipartite(s, d)))
_add("label_propagation", lambda s, d: graphs.label_propagation(_co(s, d), "row_count"))

# Streams (an extension): the batch side of the same functions
_add(
    "windowed_rates", lambda s, d: streams.windowed_rates(b.events(s, d), "ts", "event_type", "degraded", "1 day").withColumn("window_start", F.unix_timestamp("window_start")),
    f"{E} SELECT epoch(date_trunc('day', ts))::BIGINT AS window_start, event_type, {RATE} FROM e GROUP BY 1, 2",
)
_add(
    "gap_sessions", lambda s, d: streams.session_rates(b.events(s, d), "ts", "user_id", "degraded", "12 hours").select("user_id", F.unix_micros(F.col("session_start").cast("timestamp")).alias("session_start"), "row_count", "outcome_count"),
    f"""{E}, g AS (SELECT *, coalesce((ts >= lag(ts) OVER w + INTERVAL 12 HOUR)::INT, 1) AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), n AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM g)
    SELECT user_id, epoch_us(min(ts)) AS session_start, count(*) AS row_count, sum(degraded)::BIGINT AS outcome_count FROM n GROUP BY user_id, sid""",
)


# Evidence graph and source bookkeeping
_add(
    "evidence_nodes", lambda s, d: graphs.evidence_graph(_pairs(s, d), "click")[0].select("node_type", "node_label"),
    f"{DIST} SELECT DISTINCT 'metric' AS node_type, metric AS node_label FROM k UNION SELECT 'source', 'click' UNION SELECT 'source', reference FROM k UNION SELECT 'comparison', metric || '|click|' || reference FROM k",
)
_add(
    "evidence_edges", lambda s, d: graphs.evidence_graph(_pairs(s, d), "click")[1].groupBy("edge_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("target").alias("targets")),
    f"{DIST} SELECT 'compares_metric' AS edge_type, count(*) AS n, count(DISTINCT metric) AS targets FROM k UNION ALL SELECT 'compares_main', count(*), 1 FROM k UNION ALL SELECT 'compares_reference', count(*), count(DISTINCT reference) FROM k",
)
_add(
    "view_summary",
    lambda s, d: graphs.view_summary(graphs.context_nodes(_rows(s, d), b.CONTEXTS, "degraded").withColumn("graph_view", F.lit("context")), _co(s, d).withColumn("graph_view", F.lit("context")).unionByName(_steps(s, d).withColumn("graph_view", F.lit("warehouse")), allowMissingColumns=True)),
    f"{CO}, {b.EVENTS_SQL}, tr AS ({STEPS}) SELECT 'context' AS graph_view, (SELECT count(DISTINCT node_id) FROM c) AS nodes, (SELECT count(*) FROM co) AS edges UNION ALL SELECT 'warehouse', 0, (SELECT count(*) FROM tr)",
)
_add(
    "filter_audit", lambda s, d: compare.filter_audit(compare.long_frame(b.lines(s, d, order=True), "l_returnflag", FILTERED, "o_orderstatus"), FILTERED),
    f"{L} SELECT 'quantity' AS metric, 'R' AS source, 'O' AS only_context, count(*) AS n FROM d WHERE l_returnflag = 'R' AND o_orderstatus = 'O'",
)
_add("expected_grid", lambda s, d: tables.expected_grid(s, traffic=["low", "high"], scheduler=["ofdma", "tdma"], seed=[1, 2, 3]), "SELECT * FROM (SELECT unnest(['low', 'high']) AS traffic), (SELECT unnest(['ofdma', 'tdma']) AS scheduler), (SELECT unnest([1, 2, 3]) AS seed)")
_add(
    "artifact_manifest", lambda s, d: tables.manifest({t: b.table(s, d, t) for t in ("nation", "region", "orders")}),
    "SELECT 'nation' AS artifact, 'parquet' AS kind, count(*) AS row_count FROM nation UNION ALL SELECT 'orders', 'parquet', count(*) FROM orders UNION ALL SELECT 'region', 'parquet', count(*) FROM region",
)
