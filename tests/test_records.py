"""Counting CSV records in splits, and inferred types, against plain readers."""

import csv
import io
import random

import pytest

from tessera.operators import profile
from tessera.sources import records, tables


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "150", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    old = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_records_of_one_file_in_many_tasks(spark, tmp_path, small_splits):
    r = random.Random(3)
    want = {}
    for f in range(4):
        out = io.StringIO()
        writer = csv.writer(out, lineterminator="\n", quoting=csv.QUOTE_ALL if f == 1 else csv.QUOTE_MINIMAL)
        for i in range(120):
            writer.writerow([i, "".join(r.choice('ab",\n é') for _ in range(r.randint(0, 40))), 'a "b" c', ""])
        text = out.getvalue()
        text += {0: "", 1: 'last,"open\nfield', 2: '\n\nx"y,"z"\n', 3: "no end of line"}[f]
        (tmp_path / f"f{f}.csv").write_text(text)
        want[f"f{f}.csv"] = sum(1 for _ in csv.reader(io.StringIO(text, newline="")))
    lines = spark.read.text(str(tmp_path))
    assert lines.rdd.getNumPartitions() > 40
    got = {row.path.rpartition("/")[2]: row.records for row in records.csv_records(spark, str(tmp_path)).collect()}
    assert got == want
    assert tables.csv_rows(spark, str(tmp_path)) == sum(n - 1 for n in want.values())


@pytest.mark.parametrize("line, outside, inside", [("a,b", False, True), ('"a', True, False), ('a",b', False, False), ('"a""', True, True), ('x"y', False, False), ('"",', False, False), ('","', False, True), ("", False, True)])
def test_states_of_a_line(line, outside, inside):
    """Outside: as the reader has it after a line break; inside: behind an open quote."""
    assert records.ends_inside(line, False) is outside
    rows = list(csv.reader(io.StringIO('"' + line + "\nnext", newline="")))
    assert records.ends_inside(line, True) == (len(rows) == 1)


def test_inferred_types(spark):
    rows = [("1", "1.5", "true", "x", None, 2.0, 1.5, " 7 ", "1e3", "1"), (None, "2", "FALSE", "1", None, None, 2.0, "-8", ".5", "true"), ("-3", "-2.", None, "", None, 4.0, None, "+9", "3", None)]
    names = "whole number flag text nothing doubles halves padded science mixed".split()
    df = spark.createDataFrame(rows, ", ".join(f"{n} {'double' if n in ('doubles', 'halves') else 'string'}" for n in names))
    got = {r.column_name: r.inferred_type for r in profile.inferred_types(df).collect()}
    assert got == {"whole": "bigint", "number": "double", "flag": "boolean", "text": "string", "nothing": "string", "doubles": "bigint", "halves": "double", "padded": "bigint", "science": "double", "mixed": "string"}
    first = profile.converted(df).first()
    assert (first.whole, first.number, first.flag, first.doubles, first.padded, first.science) == (1, 1.5, True, 2, 7, 1000.0)
    assert {r.inferred_type for r in profile.inferred_types(df.where("false")).collect()} == {"string", "double"}
