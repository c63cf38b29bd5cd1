"""The audit of filter orders against applying every order to a list of documents."""

import itertools
import re

import pytest
from pyspark.sql import functions as F

from tessera.llm import filter_audit

LONG = " ".join(f"word{i}" for i in range(60))
DOCS = [
    (1, LONG, "a"), (2, LONG, "a"), (3, LONG, None), (4, "short", "a"), (5, "SHORT # text", "b"), (6, None, ""), (7, "", None), (8, None, "b"), (None, LONG, "a"), (None, "short", "b"),
    (9, "same " * 80, "b"), (10, "same " * 80 + "&", "b"), (11, LONG + " $", "a"), (12, LONG.upper(), "a"), (13, LONG.upper() + "|", "c"), (12, LONG.upper(), "a"), (14, LONG + "É" * 40, "a"), (15, "x" * 60_000, "c"),
]
LABELS = [(1, 1, 0), (2, 1, 0), (2, 0, 1), (4, 1, None), (5, None, 1), (9, 0, 1), (11, 1, 0), (12, 1, 1), (None, 1, 1), (99, 1, 1)]


def fails(rows):
    out = []
    for d, text, _ in rows:
        text = text or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
        out.append({
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), "D": bool(re.search(r"[#$%&*|]", text)),
            "E": any(o is not None and d is not None and o < d and (t or "") == text for o, t, _ in rows),
        })
    return out


def plain(rows, labels):
    failing = fails(rows)
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    out = {}
    for part in {s or "" for _, _, s in rows}:
        own = [i for i, r in enumerate(rows) if (r[2] or "") == part]
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [i for i in left if failing[i][f]]
                left = [i for i in left if not failing[i][f]]
                every = [i for i in own if failing[i][f]]
                alone = sum(sum(failing[i].values()) == 1 for i in every)
                out[part, "".join(order), step] = [len(left), len(gone), len(every) - len(gone), alone, sum(rows[i][0] in good for i in gone), sum(rows[i][0] in toxic for i in gone)]
        for f in "ABCDE":
            share = sum(v[1] for (p, o, s), v in out.items() if p == part and o[s - 1] == f)
            for (p, o, s), v in out.items():
                if p == part and o[s - 1] == f:
                    v.append(share)
    return out


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame([(*d, 1, True, "E") for d in DOCS], "doc_id long, text string, source string, A int, good boolean, digest string")
    return docs.repartition(3), spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


def test_all_orders(tables):
    rows = filter_audit.filter_audit(*tables).collect()
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in rows}
    assert len(rows) == len(got) == 4 * 600
    assert got == plain(DOCS, LABELS)


def test_empty_tables(tables):
    docs, labels = tables
    assert filter_audit.filter_audit(docs.where("false"), labels).count() == 0
    none = filter_audit.filter_audit(docs, labels.where("false"))
    assert none.agg(F.sum("good_lost") + F.sum("toxic_lost")).first()[0] == 0


def test_states_are_made_once(tables, spark):
    """One state for each set of filters that leaves another to come, and no state left in memory."""
    rows = filter_audit.verdicts(*tables)
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    edges = filter_audit.edge_counts(rows, "ABCDE")
    assert edges.select("before").distinct().count() == 31
    assert edges.select("before", "letter").distinct().count() == 80
    assert edges.count() == edges.select("part", "before", "letter").distinct().count()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before
