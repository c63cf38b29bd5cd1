"""Block-max search against a plain ranking of all documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tessera.llm import blockmax

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, queries, k):
    """All scores of all documents, as the formula says."""
    counted = [(d, Counter(terms(t))) for d, t in docs]
    counted = [(d, c, sum(c.values())) for d, c in counted if c]
    n_docs, total = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    wanted = {}
    for item, text in queries:
        wanted.setdefault(item, set()).update(terms(text))
    out = []
    for item, asked in wanted.items():
        scored = []
        for d, c, n in counted:
            m = 10 + (90 * n * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in asked if t in c)
            if s > 0:
                scored.append((-s, d is None, d or 0))
        out += [(item, r + 1, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def found(rows):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in rows.collect()), key=str)


@pytest.mark.parametrize("shard_bytes, block, pairs", [(1500, 3, 20), (1 << 20, 128, 1 << 18)])
def test_against_all_documents(spark, make, shard_bytes, block, pairs):
    r = random.Random(block)
    words = [f"w{i}" for i in range(60)] + ["É", "ß", "中文", "Long" * 50]
    weights = [1 / (i + 1) for i in range(len(words))]
    text = lambda n: " ".join(r.choices(words, weights, k=n)) + r.choice(["", ".", "\n x-y_z"])
    docs = [(i, text(r.randint(1, 60))) for i in range(300)] + [(1000 + i, "w1 w2 w3 w50") for i in range(40)]  # ties
    docs += [(None, "w50 w51"), (None, None), (5000, ""), (5001, None), (5002, "..."), (3, "w59 w59 again"), (6000, text(4000))]
    queries = [(i, text(r.randint(1, 12))) for i in range(25)] + [(None, "W50 w51"), (90, None), (91, "nobody has this"), (3, "w59"), (92, "w1 w2 w3 w50")]
    r.shuffle(docs)
    index = blockmax.build_index(make(docs).repartition(3), shard_bytes=shard_bytes, block=block)
    assert index.rows.where("term IS NULL").count() > (10 if shard_bytes == 1500 else 1)
    asked = spark.createDataFrame([(*q, "x") for q in queries], "item_id long, text string, k string")
    assert found(blockmax.search(index, asked, 5, block_pairs=pairs, block=block)) == plain(docs, queries, 5)


def test_empty_tables(spark, make):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a word")], "item_id long, text string")
    assert blockmax.ranked_search(make([(1, "a word")]), none).count() == 0
    for docs in ([], [(1, None), (None, ""), (2, "?!")]):
        assert blockmax.ranked_search(make(docs) if docs else make([(1, "a")]).where("false"), some).count() == 0


def lists_of(rng, n_docs, lists):
    doc = [np.sort(rng.choice(n_docs, size, replace=False)) for size in lists]
    tf = [rng.integers(1, 2 ** int(rng.integers(1, 12)), len(d)) for d in doc]
    return doc, tf


def shard_of(doc, tf, n, block, total=1000):
    flat, counts = np.concatenate(doc), np.array([len(d) for d in doc])
    first = np.cumsum(counts) - counts
    tfs = np.concatenate(tf)
    p = blockmax.pack(flat, tfs, blockmax.impacts(tfs, n[flat], len(n), total), first, block)
    return blockmax.Shard(np.arange(len(n)) * 7, n, counts, p["last"], p["top"], p["widths"], p["data"], p["place"][p["first_block"]], len(n), total, block)


def test_blocks_round_trip():
    rng = np.random.default_rng(1)
    n = rng.integers(1, 500, 5000)
    doc, tf = lists_of(rng, 5000, [1, 2, 127, 128, 129, 5000, 700, 256])
    shard = shard_of(doc, tf, n, 128)
    shard.decompress(np.arange(len(shard.size))[::-1])
    assert (shard.doc == np.concatenate(doc)).all()
    assert (shard.impact == blockmax.impacts(np.concatenate(tf), n[np.concatenate(doc)], len(n), 1000)).all()


def test_blocks_below_the_threshold_stay_compressed():
    """Ten documents hold what is asked for many times: most blocks of the common term are never opened."""
    n = np.full(20_000, 50)
    tf = np.ones(20_000, np.int64)
    tf[5000:5010] = 40
    shard = shard_of([np.arange(20_000), np.arange(5000, 5010)], [tf, np.full(10, 30)], n, 128, 1_000_000)
    ids, scores = shard.search(np.array([0, 1]), np.array([3, 900]), 10, 1)
    assert (ids // 7 == np.arange(5000, 5010)).all() and (np.diff(scores) == 0).all()
    assert shard.open.sum() < 0.2 * len(shard.open)
    assert len(shard.search(np.array([0, 1]), np.array([3, 900]), 10, int(scores[0]) + 1)[0]) == 0
