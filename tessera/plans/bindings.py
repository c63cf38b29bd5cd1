"""Roles of the driver's tables: which columns play measurement, session, context and outcome.

Two measurement streams are bound: order lines in a star of orders, customers and parts, and events
of users.  A query names the joins that it needs, since an unused left join is not removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import exprs
from tessera.operators import labels
from tessera.plans.specs import BinSpec, ContextSpec, DimensionSpec, FactSpec, LabelSpec, MetricSpec


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


OUTCOME = LabelSpec("degraded", {
    "high_discount": lambda: F.col("l_discount") >= 0.08,
    "high_quantity": lambda: F.col("l_quantity") >= 45,
    "low_value": lambda: exprs.safe_divide("l_extendedprice", F.col("l_quantity") * 2000) <= 0.35,
})
COMPONENTS = list(OUTCOME.components)

DIM_AREA = DimensionSpec("area", "area_id", ("r_name", "n_name"))
DIM_DEVICE = DimensionSpec("device", "device_id", ("c_mktsegment",))
DIM_NETWORK = DimensionSpec("network", "network_id", ("l_returnflag", "l_linestatus"))
DIM_RADIO = DimensionSpec("radio", "radio_id", ("p_brand", "p_type"))
DIM_MOBILITY = DimensionSpec("mobility", "mobility_id", ("o_orderpriority",))
DIM_SERVICE = DimensionSpec("service_state", "service_state_id", ("o_orderstatus",))
DIM_TIME = DimensionSpec("time", "time_id", ("ship_month", "is_weekend"))
DIMENSIONS = [DIM_TIME, DIM_AREA, DIM_DEVICE, DIM_NETWORK, DIM_RADIO, DIM_MOBILITY, DIM_SERVICE]
FACT = FactSpec(("measurement_id", "session_id"), ("l_quantity", "l_extendedprice", "l_discount", "l_tax"))

CONTEXTS = [ContextSpec(f, c) for f, c in (("area", "r_name"), ("device", "c_mktsegment"), ("network", "l_returnflag"), ("mobility", "o_orderpriority"), ("service_state", "o_orderstatus"), ("status", "l_linestatus"))]
GROUPS = ["r_name", "c_mktsegment", "l_returnflag", "l_linestatus", "o_orderpriority", "o_orderstatus"]
PAIRS = [("r_name", "c_mktsegment"), ("l_returnflag", "l_linestatus"), ("o_orderpriority", "o_orderstatus")]
ORDER = ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey"]

BINS = [
    BinSpec("l_quantity", (float("-inf"), 10.0, 25.0, 40.0, float("inf")), ("quantity_low", "quantity_moderate", "quantity_high", "quantity_severe")),
    BinSpec("l_discount", (float("-inf"), 0.02, 0.05, 0.08, float("inf")), ("discount_low", "discount_moderate", "discount_high", "discount_severe")),
]
ITEM_COLUMNS = ["r_name", "c_mktsegment", "l_returnflag", "l_linestatus", "o_orderpriority", "o_orderstatus", "l_quantity_bin", "l_discount_bin", "degraded"]
METRICS = [MetricSpec("value", "value"), MetricSpec("k", "k")]


def lines(spark: SparkSession, sf_dir: str, order: bool = False, customer: bool = False, area: bool = False, part: bool = False) -> DataFrame:
    """Order lines with outcome labels, joined with what is asked for.

    Orders meet customers and areas before the lines do, so the lines are dealt out by order once.
    """
    df = table(spark, sf_dir, "lineitem")
    if order or customer or area:
        orders = table(spark, sf_dir, "orders")
        if customer or area:
            customers = table(spark, sf_dir, "customer")
            if area:
                places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
                customers = customers.join(places, F.col("c_nationkey") == F.col("n_nationkey"), "left")
            orders = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"), "left")
        df = df.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    if part:
        df = df.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"), "left")
    df = df.withColumns({
        "measurement_id": F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"),
        "session_id": F.col("l_orderkey").cast("string"),
        "ship_month": F.month("l_shipdate"),
        "is_weekend": F.dayofweek("l_shipdate").isin(1, 7),
    })
    return labels.add_labels(df, OUTCOME)


def binned(df: DataFrame) -> DataFrame:
    return df.withColumns({f"{b.column}_bin": exprs.cut(b.column, b.edges, b.labels) for b in BINS})


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a measurement stream; the outcome is a value of 69 or more."""
    return _measured(table(spark, sf_dir, "events"))


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a stream over the files, whether the table is one file or a folder of them."""
    return _measured(spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/[e]vents.parquet"))


def _measured(df: DataFrame) -> DataFrame:
    return df.withColumns({"k": F.get_json_object("props", "$.k").cast("int"), "degraded": (F.col("value") >= 69).cast("int"), "is_error": (F.col("event_type") == "error").cast("int")})


#: The same streams for the SQL side.
LINES_SQL = """
m AS (SELECT *, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS measurement_id, l_orderkey::VARCHAR AS session_id,
        month(l_shipdate) AS ship_month, dayofweek(l_shipdate) IN (0, 6) AS is_weekend,
        (l_discount >= 0.08)::INT AS high_discount, (l_quantity >= 45)::INT AS high_quantity,
        coalesce(CASE WHEN l_quantity > 0 THEN l_extendedprice / (l_quantity * 2000) END <= 0.35, false)::INT AS low_value
      FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
      LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN part ON l_partkey = p_partkey),
d AS (SELECT *, greatest(high_discount, high_quantity, low_value) AS degraded,
        CASE WHEN l_quantity <= 10 THEN 'quantity_low' WHEN l_quantity <= 25 THEN 'quantity_moderate' WHEN l_quantity <= 40 THEN 'quantity_high' ELSE 'quantity_severe' END AS l_quantity_bin,
        CASE WHEN l_discount <= 0.02 THEN 'discount_low' WHEN l_discount <= 0.05 THEN 'discount_moderate' WHEN l_discount <= 0.08 THEN 'discount_high' ELSE 'discount_severe' END AS l_discount_bin
      FROM m)
"""
EVENTS_SQL = """
e AS (SELECT *, json_extract_string(props, '$.k')::INT AS k, (value >= 69)::INT AS degraded, (event_type = 'error')::INT AS is_error FROM events)
"""
