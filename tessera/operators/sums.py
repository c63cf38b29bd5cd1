"""Sums of arrays over all rows of a table, for learners whose steps need a few totals of fixed size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def summed(df: DataFrame, totals: Callable[[pa.RecordBatch], dict[int, np.ndarray]]) -> dict[int, np.ndarray]:
    """Adds up what ``totals`` gives for each batch, key by key; arrays of one key have one length.

    A task passes on one array for each key, and a key's arrays are added in one task.  What comes to the
    driver is one array a key, so keys and lengths must follow from parameters, not from the rows.
    """

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                for key, array in totals(batch).items():
                    held[key] = held[key] + array if key in held else array.astype(float)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([a.tobytes() for a in held.values()], pa.binary())], names=["key", "sums"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(s.as_py(), float) for s in table.column("sums"))
        return pa.table({"key": table.column("key").slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})

    rows = df.mapInArrow(part, "key int, sums binary").groupBy("key").applyInArrow(add, "key int, sums binary").toArrow()
    return {k: np.frombuffer(s, float) for k, s in zip(rows.column("key").to_pylist(), rows.column("sums").to_pylist())}


def matrix(batch: pa.RecordBatch, column: str = "v") -> np.ndarray:
    """A list column of one length as rows of a matrix."""
    side = batch.column(column)
    return side.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(side), -1)
