"""Transitions of a stream against those of a table, with rows out of order, late rows, gaps and nulls."""

import datetime as dt
import itertools
import os

import pytest

from tessera.operators import sessions as tables
from tessera.streaming import sessions

SCHEMA = "user string, ts timestamp, id long, state int, source string"
START = dt.datetime(2024, 1, 1)


def rows_of(*cells):
    """(user, seconds, id, state) -> rows."""
    return [(u, None if s is None else START + dt.timedelta(seconds=s), i, state, "x") for u, s, i, state in cells]


def stream(spark, folder, batches, **how):
    """One micro-batch for each list of rows, in order."""
    for n, batch in enumerate(batches):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.parquet(f"{folder}/b{n}")
        for name in os.listdir(f"{folder}/b{n}"):
            os.utime(f"{folder}/b{n}/{name}", (1_700_000_000 + 60 * n,) * 2)
    read = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("maxFileAge", "10000d").parquet(f"{folder}/b*")
    out = sessions.replayed(spark, sessions.session_transitions(read, "user", "ts", "id", "state", **how))
    return sorted((tuple(r) for r in out.collect()), key=str)


def expected(batches, delay, gap=None):
    """Rows later than the watermark of earlier batches are dropped; edges of what the last watermark has passed."""
    mark, seen, kept = -1e18, -1e18, []
    for batch in batches:
        fresh = [r for r in batch if r[0] is not None and r[1] is not None and r[1].timestamp() > mark]
        kept += fresh
        seen = max([seen, *(r[1].timestamp() for r in batch if r[0] is not None and r[1] is not None)])
        mark = max(mark, seen - delay)
    kept = sorted((r for r in kept if r[1].timestamp() <= mark), key=lambda r: (r[0], r[1], r[2]))
    out = []
    for (u, s, i, a, _), (v, t, j, b, _) in itertools.pairwise(kept):
        if u == v and (gap is None or (t - s).total_seconds() <= gap):
            out.append((u, i, j, a, b))
    return sorted(out, key=str)


BATCHES = [
    rows_of(("a", 10, 1, 0), ("b", 12, 2, 1), ("a", 5, 3, 1), (None, 7, 4, 0), ("a", None, 5, 0), ("c", 100, 6, None)),
    rows_of(("a", 95, 7, 1), ("b", 90, 8, 0), ("a", 20, 9, 1), ("b", 160, 10, 1), ("a", 95, 11, 0)),  # id 9 is late
    rows_of(("a", 130, 12, 0), ("c", 130, 13, 1), ("a", 99, 14, 1), ("b", 300, 15, 0)),  # id 14 is late
    rows_of(("a", 290, 16, 1), ("c", 291, 17, None), ("b", 295, 18, 0)),
    rows_of(("z", 5000, 19, 0)),
    rows_of(("a", 5100, 20, 1), ("z", 9000, 21, 0)),
]


@pytest.mark.parametrize("gap", [None, 60])
def test_late_rows_gaps_and_nulls(spark, tmp_path, gap):
    got = stream(spark, str(tmp_path), BATCHES, gap=gap, watermark="40 seconds")
    assert got == expected(BATCHES, 40, gap)
    assert not {9, 14} & {x for r in got for x in r[1:3]}
    assert ("a", 16, 20, 1, 1) in got if gap is None else ("a", 16, 20, 1, 1) not in got


@pytest.mark.parametrize("gap", [None, 60])
def test_table_and_stream_of_the_same_rows(spark, tmp_path, gap):
    rows = [r for batch in BATCHES for r in batch]
    table = spark.createDataFrame(rows, SCHEMA)
    want = sorted((tuple(r) for r in sessions.session_transitions(table, "user", "ts", "id", "state", gap=gap).collect()), key=str)
    assert want == expected([rows], 0, gap) == stream(spark, str(tmp_path), [rows], gap=gap, watermark="0 seconds")
    if gap is None:
        same = tables.transitions(table.where("user IS NOT NULL AND ts IS NOT NULL"), "user", ["ts", "id"], "id", "state")
        assert sorted((tuple(r) for r in same.collect()), key=str) == want


def test_empty_stream(spark, tmp_path):
    assert stream(spark, str(tmp_path), [[]], watermark="0 seconds") == []
