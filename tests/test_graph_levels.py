"""Label propagation in levels against the sequential sweep."""

import random

import pytest

from tessera.operators import graphs


def brute(edges, sweeps=10):
    near = {}
    for a, b, w in edges:
        for s, t in ((a, b), (b, a)):
            near.setdefault(s, {})
            near[s][t] = near[s].get(t, 0.0) + w
    label = {n: n for n in near}
    for _ in range(sweeps):
        moved = False
        for n in sorted(near, key=lambda n: (-sum(near[n].values()), n)):
            votes = {}
            for m, w in near[n].items():
                votes[label[m]] = votes.get(label[m], 0.0) + w
            best = min(votes, key=lambda c: (-votes[c], c))
            moved, label[n] = moved or best != label[n], best
        if not moved:
            break
    ids = {c: i for i, c in enumerate(sorted(set(label.values())))}
    return {n: ids[c] for n, c in label.items()}


def random_edges(r, nodes, links):
    """Weights are eighths, so sums are exact in any order; loops and repeated edges are among them."""
    name = lambda: f"n{r.randrange(nodes)}"
    return [(name(), name(), r.randint(1, 12) / 8) for _ in range(links)]


@pytest.mark.parametrize("seed, nodes, links, sweeps", [(1, 40, 60, 3), (2, 12, 24, 10)])
def test_levels_equal_the_sequential_sweep(spark, seed, nodes, links, sweeps):
    edges = random_edges(random.Random(seed), nodes, links)
    df = spark.createDataFrame(edges, "source string, target string, w double")
    want = brute(edges, sweeps)
    for few in (0, 50_000):
        got = {r.node_id: r.community for r in graphs.label_propagation(df, "w", sweeps, few).collect()}
        assert got == want, few
    assert len(set(want.values())) > 1


def test_levels_of_a_chain_and_a_star(spark):
    chain = [(f"c{i}", f"c{i + 1}", float(10 - i)) for i in range(5)]
    star = [("hub", f"s{i}", 1.0) for i in range(6)]
    sym = graphs.symmetric(spark.createDataFrame(chain + star, "source string, target string, w double"), "w")
    got = {r.node_id: r.level for r in graphs.update_levels(sym, "w").collect()}
    assert got["hub"] == 1 and {got[f"s{i}"] for i in range(6)} == {2}
    assert got["c1"] == 1 and got["c2"] == 2 and got["c0"] == 2 and got["c5"] == 5
    empty = spark.createDataFrame([], "source string, target string, w double")
    assert graphs.label_propagation(empty, "w", few=0).count() == graphs.label_propagation(empty, "w").count() == 0
