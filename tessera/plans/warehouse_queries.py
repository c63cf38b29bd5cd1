"""Warehouse, label, OLAP and profile queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import exprs
from tessera.functions.names import available
from tessera.operators import labels, olap, profile, warehouse
from tessera.plans import bindings as b
from tessera.sources import tables

L, E = f"WITH {b.LINES_SQL}", f"WITH {b.EVENTS_SQL}"
QUERIES, SQL = {}, {}


def _add(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


RATE = "count(*) AS row_count, sum(degraded)::BIGINT AS outcome_count, sum(degraded)::BIGINT / count(*) AS outcome_rate"
_add("group_rate", lambda s, d: olap.group_rates(b.lines(s, d), "l_returnflag", "degraded"), f"{L} SELECT l_returnflag, {RATE} FROM d GROUP BY 1")
_add(
    "group_rate_wilson",
    lambda s, d: olap.with_wilson(olap.group_rates(b.lines(s, d, area=True), "r_name", "degraded")).withColumns({c: F.round(c, 9) for c in ("ci_low", "ci_high")}).orderBy(F.desc("outcome_rate"), F.desc("row_count")),
    f"""{L}, g AS (SELECT r_name, {RATE}, 1.959963984540054 AS z FROM d GROUP BY 1)
    SELECT r_name, row_count, outcome_count, outcome_rate,
      round(greatest(0, (outcome_rate + z*z/(2*row_count) - z*sqrt(outcome_rate*(1-outcome_rate)/row_count + z*z/(4.0*row_count*row_count)))/(1+z*z/row_count)), 9) AS ci_low,
      round(least(1, (outcome_rate + z*z/(2*row_count) + z*sqrt(outcome_rate*(1-outcome_rate)/row_count + z*z/(4.0*row_count*row_count)))/(1+z*z/row_count)), 9) AS ci_high FROM g""",
)
_add("all_group_rates", lambda s, d: olap.all_group_rates(b.lines(s, d, area=True), b.GROUPS, "degraded"), f"{L} " + " UNION ALL ".join(f"SELECT '{c}' AS group_column, {c} AS group_value, {RATE} FROM d GROUP BY {c}" for c in b.GROUPS))
CROSS = " UNION ALL ".join(f"SELECT '{x}' AS row_group, '{y}' AS column_group, {x} AS row_value, {y} AS column_value, {RATE} FROM d GROUP BY {x}, {y}" for x, y in b.PAIRS)
_add("crosstab_rates", lambda s, d: olap.crosstabs(b.lines(s, d, area=True), b.PAIRS, "degraded"), f"{L} {CROSS}")
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
_add(
    "interaction_matrix",
    lambda s, d: olap.interaction_matrix(olap.crosstabs(b.lines(s, d, area=True), b.PAIRS[:1], "degraded"), "r_name", "c_mktsegment", SEGMENTS),
    f"{L} SELECT r_name AS row_value, " + ", ".join(f"(sum(degraded) FILTER (c_mktsegment = '{x}'))::BIGINT / nullif(count(*) FILTER (c_mktsegment = '{x}'), 0) AS \"{x}\"" for x in SEGMENTS) + " FROM d GROUP BY 1",
)
_add("frequency_table", lambda s, d: olap.frequencies(b.lines(s, d, area=True), b.GROUPS), f"{L} " + " UNION ALL ".join(f"SELECT '{c}' AS column_name, {c} AS value, count(*) AS n, count(*) / (SELECT count(*) FROM d) AS fraction FROM d GROUP BY {c}" for c in b.GROUPS))
_add(
    "kpi_summary", lambda s, d: olap.kpis(b.lines(s, d), "degraded", "session_id"),
    f"{L} SELECT 'row_count' AS metric, count(*)::DOUBLE AS value FROM d UNION ALL SELECT 'outcome_count', sum(degraded)::DOUBLE FROM d UNION ALL SELECT 'outcome_fraction', sum(degraded)::BIGINT / count(*) FROM d UNION ALL SELECT 'session_count', count(DISTINCT session_id)::DOUBLE FROM d",
)
_add(
    "rollup_stats", lambda s, d: olap.rollup_stats(b.lines(s, d, area=True), ["r_name", "n_name"], "degraded"),
    f"{L} SELECT r_name, n_name, {RATE}, 0 AS level FROM d GROUP BY r_name, n_name UNION ALL SELECT r_name, NULL, {RATE}, 1 FROM d GROUP BY r_name UNION ALL SELECT NULL, NULL, {RATE}, 2 FROM d",
)
_add(
    "signature_topk", lambda s, d: olap.signature(olap.all_group_rates(b.lines(s, d, area=True), b.GROUPS, "degraded"), 3, 10),
    f"{L}, g AS (" + " UNION ALL ".join(f"SELECT '{c}' AS group_column, {c} AS group_value, {RATE} FROM d GROUP BY {c}" for c in b.GROUPS) + """),
    r AS (SELECT *, row_number() OVER (PARTITION BY group_column ORDER BY outcome_rate DESC, row_count DESC, group_value)::INT AS rank_in_group FROM g)
    SELECT * FROM r WHERE rank_in_group <= 3 ORDER BY outcome_rate DESC, row_count DESC, group_column, group_value LIMIT 10""",
)
_add(
    "bubble_scaling", lambda s, d: olap.bubble_sizes(olap.group_rates(b.lines(s, d, part=True), "p_type", "degraded"), "outcome_rate").withColumn("marker_size", F.round("marker_size", 6)),
    f"{L}, g AS (SELECT p_type, {RATE} FROM d GROUP BY 1) SELECT *, round(CASE WHEN max(outcome_rate) OVER () > min(outcome_rate) OVER () THEN 80 + (outcome_rate - min(outcome_rate) OVER ()) / (max(outcome_rate) OVER () - min(outcome_rate) OVER ()) * 480 ELSE 320 END, 6) AS marker_size FROM g",
)

# Labels
_add(
    "label_audit", lambda s, d: labels.label_audit(b.lines(s, d), [*b.COMPONENTS, "degraded"]),
    f"{L} " + " UNION ALL ".join(f"SELECT '{c}' AS label, count(*) AS row_count, sum({c})::BIGINT AS positive_count, sum({c})::BIGINT / count(*) AS positive_fraction, CASE WHEN sum({c}) IN (0, count(*)) THEN 'review' ELSE 'ok' END AS status FROM d" for c in [*b.COMPONENTS, "degraded"]),
)
_add(
    "label_unique_positive", lambda s, d: labels.component_summary(b.lines(s, d), b.COMPONENTS, "degraded"),
    f"{L} " + " UNION ALL ".join(f"SELECT '{c}' AS component, sum({c})::BIGINT AS positive_count, count(*) FILTER ({c} = 1 AND {' + '.join(b.COMPONENTS)} = 1) AS unique_positive_count, sum(degraded)::BIGINT AS outcome_count, sum({c})::BIGINT / sum(degraded)::BIGINT AS share_of_outcome FROM d" for c in b.COMPONENTS),
)


def _service(s, d):
    """The full service-quality rules, with events standing in for measurements."""
    e = b.events(s, d).select("event_id", F.col("value").alias("latency_ms"), (F.col("k") / 50).alias("jitter_ms"), F.col("value").alias("download_speed_mbps"), F.col("k").cast("double").alias("offered_downlink_mbps"),
                              F.when(F.col("event_type") == "view", "Streaming").otherwise("Browse").alias("app_type"), (F.col("k") % 5).cast("double").alias("video_quality"), (F.col("event_type") == "error").alias("dropped_connection"))
    out = labels.service_labels(e)
    flags = ["high_latency", "high_jitter", "downlink_service_shortfall", "dropped_connection", "anomalous", "poor_video_quality"]
    return out.select("event_id", *[F.col(c).cast("int").alias(c) for c in flags], F.round("downlink_shortfall_fraction", 9).alias("shortfall"), "service_degraded")


_add(
    "service_labels", _service,
    f"""{E}, r AS (SELECT *, CASE WHEN k > 0 THEN greatest(0, least(2, value / k)) END AS ratio FROM e),
    f AS (SELECT event_id, (value >= 150)::INT AS high_latency, (k / 50 >= 1)::INT AS high_jitter, coalesce(ratio <= 0.35, false)::INT AS downlink_service_shortfall, (event_type = 'error')::INT AS dropped_connection,
      0 AS anomalous, (event_type = 'view' AND k % 5 <= 2)::INT AS poor_video_quality, CASE WHEN ratio IS NOT NULL THEN round(greatest(0, least(1, 1 - ratio)), 9) END AS shortfall FROM r)
    SELECT *, greatest(high_latency, high_jitter, downlink_service_shortfall, dropped_connection, poor_video_quality) AS service_degraded FROM f""",
)

# Warehouse
_sha = lambda prefix, parts: f"'{prefix}_' || substr(sha1({' || chr(124) || chr(124) || '.join(parts)}), 1, 12)"
_text = lambda c: f"coalesce(trim({c}::VARCHAR), '<missing>')"
_flag = lambda c: f"CASE WHEN {c} THEN 'True' WHEN NOT {c} THEN 'False' ELSE '<missing>' END"
KEYS = {
    "time": _sha("time", [_text("ship_month"), _flag("is_weekend")]), "area": _sha("area", [_text("r_name"), _text("n_name")]), "device": _sha("device", [_text("c_mktsegment")]),
    "network": _sha("network", [_text("l_returnflag"), _text("l_linestatus")]), "radio": _sha("radio", [_text("p_brand"), _text("p_type")]), "mobility": _sha("mobility", [_text("o_orderpriority")]), "service_state": _sha("service_state", [_text("o_orderstatus")]),
}
_NEEDS = {"time": {}, "area": {"area": True}, "device": {"customer": True}, "network": {}, "radio": {"part": True}, "mobility": {"order": True}, "service_state": {"order": True}}
for _spec in b.DIMENSIONS:
    _cols = ", ".join(f"{c}::INT AS {c}" if c in ("ship_month", "is_weekend") else c for c in _spec.columns)

    def _dim(s, d, spec=_spec):
        dim = warehouse.build_dimension(b.lines(s, d, **_NEEDS[spec.name]), spec)
        return dim.withColumns({c: F.col(c).cast("int") for c in available(dim, ["ship_month", "is_weekend"])})

    _add(f"dim_{_spec.name}", _dim, f"{L} SELECT DISTINCT {KEYS[_spec.name]} AS {_spec.id_column}, {_cols} FROM d")
_all = {"area": True, "part": True}


def _fact(s, d):
    return warehouse.build_fact(b.lines(s, d, **_all), b.DIMENSIONS, b.FACT)


FACT_SQL = "SELECT measurement_id, session_id, " + ", ".join(f"{KEYS[x.name]} AS {x.id_column}" for x in b.DIMENSIONS) + ", l_quantity, l_extendedprice, l_discount, l_tax FROM d"
_add("fact_keys", _fact, f"{L} {FACT_SQL}")


def _dims(s, d):
    full = b.lines(s, d, **_all)
    return {x.id_column: warehouse.build_dimension(full, x) for x in (b.DIM_AREA, b.DIM_DEVICE, b.DIM_NETWORK)}


_add(
    "fk_integrity", lambda s, d: warehouse.integrity(_fact(s, d), _dims(s, d), "measurement_id"),
    f"""{L}, f AS ({FACT_SQL}), c(n, v, ok) AS (
      SELECT 'fact_rows', count(*)::VARCHAR, count(*) > 0 FROM f UNION ALL SELECT 'fact_duplicate_ids', (count(*) - count(DISTINCT measurement_id))::VARCHAR, count(*) = count(DISTINCT measurement_id) FROM f
      """ + "".join(f" UNION ALL SELECT 'missing_{i}', (count(*) - count({i}))::VARCHAR, count(*) = count({i}) FROM f UNION ALL SELECT '{i}_rows', count(DISTINCT {i})::VARCHAR, true FROM f UNION ALL SELECT '{i}_duplicates', '0', true FROM (SELECT 1)" for i in ("area_id", "device_id", "network_id")) + """)
    SELECT n AS check_name, v AS check_value, CASE WHEN ok THEN 'ok' ELSE 'failed' END AS status FROM c""",
)


def _star(s, d):
    joined = warehouse.star_join(_fact(s, d), _dims(s, d), wanted=["area_id", "device_id"], validate=True)
    return joined.groupBy("r_name", "c_mktsegment").agg(F.count(F.lit(1)).alias("row_count"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"))


_add("star_join_kpi", _star, f"{L} SELECT r_name, c_mktsegment, count(*) AS row_count, sum(l_quantity)::BIGINT AS quantity FROM d GROUP BY 1, 2")
_add(
    "column_coverage", lambda s, d: warehouse.column_coverage(b.lines(s, d, order=True).select("measurement_id", "l_quantity", "l_returnflag", "o_orderstatus", "l_tax", "l_shipdate"), b.DIMENSIONS, b.FACT).withColumn("is_covered", F.col("is_covered").cast("int")),
    "SELECT * FROM (VALUES ('measurement_id', 'fact', 1), ('l_quantity', 'fact', 1), ('l_returnflag', 'network', 1), ('o_orderstatus', 'service_state', 1), ('l_tax', 'fact', 1), ('l_shipdate', 'unused', 0)) t(column_name, warehouse_table, is_covered)",
)

# Scalars
_add(
    "time_of_day_bins", lambda s, d: b.events(s, d).groupBy(exprs.time_of_day(F.hour("ts")).alias("time_of_day")).agg(F.count(F.lit(1)).alias("n")),
    f"{E} SELECT CASE WHEN hour(ts) < 6 THEN 'night' WHEN hour(ts) < 12 THEN 'morning' WHEN hour(ts) < 18 THEN 'afternoon' ELSE 'evening' END AS time_of_day, count(*) AS n FROM e GROUP BY 1",
)
_add("cut_bins", lambda s, d: b.binned(b.lines(s, d)).groupBy("l_quantity_bin", "l_discount_bin").agg(F.count(F.lit(1)).alias("n")), f"{L} SELECT l_quantity_bin, l_discount_bin, count(*) AS n FROM d GROUP BY 1, 2")
_add(
    "technology_case", lambda s, d: b.table(s, d, "part").select("p_partkey", exprs.technology(F.concat(F.element_at(F.array(*[F.lit(x) for x in ("5G NSA", "LTE", "HSPA+", "EDGE", "Wi-Fi", "LTE 5G")]), (F.col("p_partkey") % 6 + 1).cast("int")))).alias("technology")),
    "SELECT p_partkey, ['5g', 'lte', '3g', '2g', 'unknown', 'lte'][(p_partkey % 6 + 1)::INT] AS technology FROM part",
)


def _stamps(s, d):
    e = b.events(s, d)
    shape = lambda f: F.date_format("ts", f)
    text = F.when(F.col("event_id") % 4 == 0, shape("yyyy.MM.dd_HH.mm.ss")).when(F.col("event_id") % 4 == 1, shape("yyyy-MM-dd HH:mm:ss")).when(F.col("event_id") % 4 == 2, shape("yyyy/MM/dd HH:mm:ss")).otherwise("not a time")
    parsed = exprs.parse_timestamp(text)
    return e.select("event_id", F.unix_timestamp(parsed).alias("epoch"), parsed.isNull().cast("int").alias("timestamp_parse_failed"))


_add("multi_format_timestamp", _stamps, f"{E} SELECT event_id, CASE WHEN event_id % 4 < 3 THEN epoch(date_trunc('second', ts))::BIGINT END AS epoch, (event_id % 4 = 3)::INT AS timestamp_parse_failed FROM e")
_add(
    "percent_like_fraction",
    lambda s, d: tables.fraction_from_percent(b.events(s, d).select("event_id", (F.col("user_id") % 7).alias("file"), F.when(F.col("user_id") % 7 < 3, F.col("k") / 100).otherwise(F.col("k").cast("double")).alias("share")), "share", "file"),
    f"{E}, f AS (SELECT event_id, user_id % 7 AS file, CASE WHEN user_id % 7 < 3 THEN k / 100 ELSE k::DOUBLE END AS share FROM e) SELECT event_id, file, CASE WHEN max(share) OVER (PARTITION BY file) > 1 THEN share / 100 ELSE share END AS share FROM f",
)
MAPPING = {"signal_dbm": (["Signal DBM", "value"], "double", 1.0), "frequency_ghz": (["K"], "double", 1e-6), "technology": (["event type"], "string", 1.0), "jitter_ms": (["jitter"], "double", 1.0)}
_add(
    "column_conform", lambda s, d: tables.union_sources([tables.conform(b.events(s, d), MAPPING, "events"), tables.conform(b.table(s, d, "part").withColumnRenamed("p_retailprice", "signal_dbm"), MAPPING, "parts")]).groupBy("source_dataset").agg(F.count(F.lit(1)).alias("n"), F.count("signal_dbm").alias("signals"), F.count("frequency_ghz").alias("frequencies"), F.count("jitter_ms").alias("jitters"), F.max("signal_dbm").alias("top")),
    f"{E} SELECT 'events' AS source_dataset, count(*) AS n, count(value) AS signals, count(k) AS frequencies, 0::BIGINT AS jitters, max(value) AS top FROM e UNION ALL SELECT 'parts', count(*), count(p_retailprice), 0, 0, max(p_retailprice) FROM part",
)
_add(
    "safe_token_ids", lambda s, d: b.table(s, d, "nation").select("n_name", exprs.safe_token(F.concat(F.lit(" (A) "), "n_name", F.lit(" / B:"))).alias("token"), exprs.node_id("context", "area", "n_name").alias("node_id"), exprs.edge_id("v", "t", "n_name", "n_regionkey").alias("edge_id")),
    """WITH t AS (SELECT *, lower(' (A) ' || n_name || ' / B:') AS raw FROM nation) SELECT n_name, trim(regexp_replace(raw, '[\\s/\\\\:;,|()\\[\\]]+', '_', 'g'), '_') AS token,
    'context:area:' || trim(regexp_replace(lower(n_name), '[\\s/\\\\:;,|()\\[\\]]+', '_', 'g'), '_') || ':' || substr(sha1(n_name), 1, 12) AS node_id, 'edge_' || substr(sha1('v||t||' || n_name || '||' || n_regionkey), 1, 18) AS edge_id FROM t""",
)

# Profiles
_add(
    "missingness", lambda s, d: profile.missingness(b.table(s, d, "orders").withColumn("o_orderstatus", F.nullif("o_orderstatus", F.lit("P")))).drop("dtype"),
    " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) - count({c}) AS missing_count, (count(*) - count({c})) / count(*) AS missing_fraction FROM (SELECT * REPLACE (nullif(o_orderstatus, 'P') AS o_orderstatus) FROM orders)" for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")),
)
_add(
    "value_profile", lambda s, d: profile.value_profile(b.table(s, d, "orders").select("o_orderstatus", "o_orderpriority", "o_custkey")),
    "SELECT 'o_orderstatus' AS column_name, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2",
)
_add(
    "dataset_summary", lambda s, d: profile.dataset_summary(b.table(s, d, "events").select("event_id", "ts", "user_id", "event_type"), ["user_id", "event_type"], "ts"),
    """SELECT 'rows' AS metric, count(*)::VARCHAR AS value FROM events UNION ALL SELECT 'columns', '4' UNION ALL SELECT 'distinct_user_id', count(DISTINCT user_id)::VARCHAR FROM events UNION ALL SELECT 'distinct_event_type', count(DISTINCT event_type)::VARCHAR FROM events
    UNION ALL SELECT 'first_timestamp', strftime(min(ts), '%Y-%m-%d %H:%M:%S') FROM events UNION ALL SELECT 'last_timestamp', strftime(max(ts), '%Y-%m-%d %H:%M:%S') FROM events""",
)
_add(
    "duplicate_audit", lambda s, d: profile.duplicate_audit(b.table(s, d, "lineitem"), [["l_orderkey", "l_linenumber"], ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]]),
    "SELECT 'l_orderkey,l_linenumber' AS key, count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS duplicate_rows FROM lineitem UNION ALL SELECT 'l_orderkey,l_linenumber,l_partkey,l_suppkey', count(*) - count(DISTINCT (l_orderkey, l_linenumber, l_partkey, l_suppkey)) FROM lineitem",
)
_add(
    "numeric_summary", lambda s, d: profile.numeric_summary(b.table(s, d, "customer"), "c_mktsegment", ["c_acctbal"]),
    "SELECT c_mktsegment, 'c_acctbal' AS metric, count(c_acctbal) AS n, 0.0 AS missing_fraction, round(avg(c_acctbal), 6) AS mean, round(stddev_samp(c_acctbal), 6) AS std, min(c_acctbal) AS min, quantile_cont(c_acctbal, 0.25) AS q25, quantile_cont(c_acctbal, 0.5) AS median, quantile_cont(c_acctbal, 0.75) AS q75, max(c_acctbal) AS max FROM customer GROUP BY 1",
)
RANGES = {"value": (0.0, 300.0), "k": (0.0, 90.0)}
_add(
    "range_audit", lambda s, d: profile.range_audit(b.events(s, d), RANGES),
    f"{E} " + " UNION ALL ".join(f"SELECT '{c}' AS column_name, {lo:.1f}::DOUBLE AS low, {hi:.1f}::DOUBLE AS high, count({c}) AS n, count(*) FILTER ({c} < {lo} OR {c} > {hi}) AS out_of_range, CASE WHEN count(*) FILTER ({c} < {lo} OR {c} > {hi}) = 0 THEN 'ok' ELSE 'review' END AS status FROM e" for c, (lo, hi) in RANGES.items()),
)
_add(
    "boolean_coercion", lambda s, d: profile.coerce_booleans(b.table(s, d, "labels").select("doc_id", F.when(F.col("quality") == 1, " Yes").otherwise("no").alias("good"), F.when(F.col("toxic") == 1, "bad").otherwise("y").alias("kind"))).select("doc_id", F.col("good").cast("int").alias("good"), "kind"),
    "SELECT doc_id, quality AS good, CASE WHEN toxic = 1 THEN 'bad' ELSE 'y' END AS kind FROM labels",
)
