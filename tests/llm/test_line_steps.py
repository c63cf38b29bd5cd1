"""Steps of the line join: what they compare, against plain versions, and that each line and key is handled once."""

import random

import numpy as np
import pyarrow as pa

from tessera.llm import lines


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_distances_of_any_lengths_and_symbols():
    r = random.Random(8)
    for kind in (np.uint32, np.uint64):
        for most in (1, 2, 4, 8):
            pairs = []
            for _ in range(150):
                a = [r.choice([0, 1, 2]) for _ in range(r.randint(1, 25))]
                b = [x for x in a if r.random() > 0.1] + [0] * r.randint(0, 3)
                pairs.append((np.array(a, kind), np.array(b, kind)))
            got = lines.distances([a for a, _ in pairs], [b for _, b in pairs], most)
            assert got.tolist() == [min(edits(a.tolist(), b.tolist()), most + 1) for a, b in pairs]
    assert len(lines.distances([], [], 2)) == 0


def test_a_line_of_many_pairs_is_spelled_once(monkeypatch):
    spelled, kept = [], lines.Spelled

    class Recorded(kept):
        def __init__(self, given):
            spelled.append(len(given))
            super().__init__(given)

    monkeypatch.setattr(lines, "Spelled", Recorded)
    one = b"the same line that many others are near"
    others = [one + b"%d" % i for i in range(50)] + ["la même ligne, longue, en d'autres lettres".encode(), b"w " * 30]
    batch = pa.RecordBatch.from_arrays([pa.array(range(52)), pa.array(range(52)), pa.array([one] * 52, pa.binary()), pa.array(others, pa.binary())], names=["h", "g", "la", "lb"])
    assert [x for b in lines._verify(iter([batch])) for x in b.column("g").to_pylist()] == list(range(50))
    assert sum(spelled) == 53


def test_keys_of_one_entry_are_not_put_in_order(monkeypatch):
    settled, put = [], lines._settled
    monkeypatch.setattr(lines, "_settled", lambda entries: settled.append(len(entries)) or put(entries))
    entries = np.zeros(1002, lines._PACKED)
    entries["key"], entries["line"] = np.append(np.arange(1001), 7) | 3 << 30, np.arange(1, 1003)
    batch = pa.RecordBatch.from_arrays([pa.array([4]), pa.array([entries.tobytes()], pa.binary())], names=["bucket", "packed"])
    found = [x for b in lines._meet(iter([batch]), 64, 10) for x in b.to_pylist()]
    assert found == [{"cell": None, "a": 8, "b": 1002}] and settled == [2]
