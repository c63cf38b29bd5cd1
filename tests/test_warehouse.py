import pytest
from pyspark.sql import functions as F

from tessera.operators import labels, quality, warehouse
from tessera.operators.quality import Check, v
from tessera.plans.specs import DimensionSpec, FactSpec

AREA = DimensionSpec("area", "area_id", ("deployment_area", "area_type"))
ENVIRONMENT = DimensionSpec("environment", "environment_id", ("weather", "is_indoor"))
ABSENT = DimensionSpec("radio", "radio_id", ("band",))
FACT = FactSpec(("measurement_id", "session_id"), ("latency_ms",))


@pytest.fixture(scope="module")
def core(spark):
    rows = [(f"m{i}", f"s{i // 3}", "A", "Urban" if i % 2 else "Rural", "Rain" if i > 3 else None, i % 2 == 0, float(i)) for i in range(6)]
    return spark.createDataFrame(rows, "measurement_id string, session_id string, deployment_area string, area_type string, weather string, is_indoor boolean, latency_ms double")


def test_star_schema(core):
    dims = {s.id_column: warehouse.build_dimension(core, s) for s in (AREA, ENVIRONMENT)}
    fact = warehouse.build_fact(core, [AREA, ENVIRONMENT, ABSENT], FACT)
    assert fact.columns == ["measurement_id", "session_id", "area_id", "environment_id", "radio_id", "latency_ms"]
    assert fact.where("radio_id IS NOT NULL").isEmpty()
    assert {k: d.count() for k, d in dims.items()} == {"area_id": 2, "environment_id": 4}
    joined = warehouse.star_join(fact, dims, validate=True)
    assert joined.count() == 6 and joined.where("area_type IS NULL").isEmpty()
    assert "weather" not in warehouse.star_join(fact, dims, wanted=["area_id"]).columns
    checks = warehouse.integrity(fact, dims, "measurement_id")
    assert quality.raise_on_failed(checks).where("status = 'ok'").count() == checks.count()
    assert warehouse.build_dimension(core, ABSENT).columns == ["radio_id"]


def test_repeated_dimension_key_raises(core):
    dim = warehouse.build_dimension(core, AREA)
    fact = warehouse.build_fact(core, [AREA], FACT)
    with pytest.raises(ValueError, match="area_id"):
        warehouse.star_join(fact, {"area_id": dim.unionByName(dim)}, validate=True)
    with pytest.raises(ValueError, match="area_id_duplicates"):
        quality.raise_on_failed(warehouse.integrity(fact, {"area_id": dim.unionByName(dim)}, "measurement_id"))


def test_audit(core):
    out = {r.check_name: (r.check_value, r.status) for r in quality.audit(core, [Check("rows", F.count(F.lit(1)), v(0) == 6), Check("late", F.max("latency_ms"), v(1) < 5, "review")]).collect()}
    assert out == {"rows": ("6", "ok"), "late": ("5.0", "review")}


def test_label_rules(spark):
    nan = float("nan")
    rows = [
        (90.0, 100.0, 30.0, 0.2, 4.0, "Browse", 0), (10.0, 100.0, 40.0, 0.2, 4.0, "Browse", 1), (80.0, 100.0, 200.0, 0.2, 4.0, "Browse", 1), (70.0, 100.0, 30.0, 2.0, 4.0, "Browse", 1),
        (90.0, 100.0, 150.0, 0.2, 4.0, "Browse", 1), (90.0, 100.0, 30.0, 1.0, 4.0, "Browse", 1), (35.0, 100.0, 30.0, 0.2, 4.0, "Browse", 1), (0.0, 0.0, 30.0, 0.2, 4.0, "Browse", 0),
        (0.0, None, 30.0, 0.2, 4.0, "Browse", 0), (90.0, 100.0, nan, 0.2, 4.0, "Browse", 0), (90.0, 100.0, None, None, 2.0, "streaming", 1), (90.0, 100.0, None, None, 2.0, None, 0),
    ]
    df = spark.createDataFrame(rows, "download_speed_mbps double, offered_downlink_mbps double, latency_ms double, jitter_ms double, video_quality double, app_type string, want int")
    out = labels.service_labels(df)
    assert out.where("service_degraded <> want OR service_degraded IS NULL").isEmpty()
    audit = {r.label: r.positive_count for r in labels.label_audit(out, ["high_latency", "service_degraded"]).collect()}
    assert audit == {"high_latency": 2, "service_degraded": 7}
