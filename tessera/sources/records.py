"""Records of CSV files, counted by many tasks for each file.

A line break ends a record unless it stands inside quotes, which only the text before it can tell.  Every
split of a file is therefore run from both states, outside and inside a quoted field, giving for each the
records that end in it and the state that it leaves; folding these few numbers over the splits of a file
from left to right gives the file's records.  Quotes are read as usual: they open a field only at its
start, two of them stand for one inside, and a file that ends inside quotes ends its last record.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ends_inside(line: str, inside: bool, delimiter: str = ",") -> bool:
    """Whether a line leaves a quoted field open."""
    at = 0
    while True:
        if inside:
            at = line.find('"', at)
            if at < 0:
                return True
            if line[at + 1 : at + 2] == '"':
                at += 2
                continue
            inside = False
        elif line[at : at + 1] == '"':
            inside, at = True, at + 1
            continue
        at = line.find(delimiter, at)
        if at < 0:
            return False
        at += 1


def _splits(batches: Iterator[pa.RecordBatch], delimiter: str) -> Iterator[pa.RecordBatch]:
    """path, start, and from each state: records that end, whether it ends inside quotes."""
    now: tuple[str, int] | None = None
    ended, state = [0, 0], [False, True]

    def row() -> pa.RecordBatch:
        values = [[now[0]], [now[1]], [ended[0]], [state[0]], [ended[1]], [state[1]]]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], names=["path", "start", "ended_out", "inside_out", "ended_in", "inside_in"])

    for batch in batches:
        if not batch.num_rows:
            continue
        paths, starts = batch.column("path").to_pylist(), batch.column("start").to_pylist()
        quoted = set(pc.indices_nonzero(pc.match_substring(batch.column("value"), '"')).to_pylist())
        for i, place in enumerate(zip(paths, starts)):
            if place != now:
                if now is not None:
                    yield row()
                now, ended, state = place, [0, 0], [False, True]
            for s in (0, 1):
                if i in quoted:
                    state[s] = ends_inside(batch.column("value")[i].as_py(), state[s], delimiter)
                ended[s] += not state[s]
    if now is not None:
        yield row()


def _fold(table: pa.Table) -> pa.Table:
    """Records of one file from its splits."""
    rows = sorted(table.to_pylist(), key=lambda r: r["start"])
    records, inside = 0, False
    for r in rows:
        records += r["ended_in" if inside else "ended_out"]
        inside = r["inside_in" if inside else "inside_out"]
    return pa.table({"path": [rows[0]["path"]], "records": pa.array([records + inside], pa.int64())})


def csv_records(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """path, records (its header included, blank lines too) of every file that is not empty."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))
    names = "path string, start long, ended_out long, inside_out boolean, ended_in long, inside_in boolean"
    return lines.mapInArrow(lambda batches: _splits(batches, delimiter), names).groupBy("path").applyInArrow(_fold, "path string, records long")
