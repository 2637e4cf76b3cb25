"""Hierarchical clusterings without the matrix of all distances."""

import tracemalloc

import numpy as np
import pytest

from tessera.operators import hierarchy
from tessera.operators.neighbours import l1_matrix


@pytest.mark.parametrize("held", [1 << 21, 1])
@pytest.mark.parametrize("seed", range(6))
def test_average_clusters_are_those_of_the_matrix(monkeypatch, seed, held):
    monkeypatch.setattr(hierarchy, "HELD", held)
    r = np.random.default_rng(seed)
    x = r.normal(0, 1, (70, 3))
    x[40 : 45 + seed] = x[: 5 + seed]  # copies
    for threshold in (0.0, 0.3, 1.0, 2.0, 9.0):
        want = hierarchy.cut_tree(70, hierarchy.average_linkage(l1_matrix(x, x)), threshold)
        assert hierarchy.average_clusters(x, threshold).tolist() == want.tolist()


def test_average_clusters_of_ties():
    # Steps of one: pairs merge first, and two of them are exactly two apart on average.
    x = np.arange(8.0)[:, None]
    assert hierarchy.average_clusters(x, 1.5).tolist() == [0, 0, 1, 1, 2, 2, 3, 3]
    assert hierarchy.average_clusters(x, 2.0).tolist() == [0, 0, 1, 1, 2, 2, 3, 3]
    assert hierarchy.average_clusters(x, 2.1).tolist() == [0, 0, 0, 0, 1, 1, 1, 1]
    assert hierarchy.average_clusters(x[:1], 5.0).tolist() == [0]


@pytest.mark.parametrize("run", [lambda x: hierarchy.average_clusters(x, 4.0), lambda x: hierarchy.reachability_order(x, 5)])
def test_no_matrix_is_held(monkeypatch, run):
    monkeypatch.setattr(hierarchy, "HELD", 1 << 14)
    x = np.random.default_rng(3).normal(0, 1, (1500, 8))
    tracemalloc.start()
    run(x)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 1500 * 1500 * 8 / 3


@pytest.mark.parametrize("most", [np.inf, 2.5])
def test_reachability_is_that_of_the_matrix(monkeypatch, most):
    monkeypatch.setattr(hierarchy, "HELD", 100)
    x = np.random.default_rng(5).normal(0, 1, (60, 3)).round(1)
    d = l1_matrix(x, x)
    core = np.sort(d, axis=1)[:, 3]
    reach, left, order = np.full(60, np.inf), set(range(60)), []
    while left:
        p = min(left, key=lambda i: (reach[i], i))
        left.remove(p)
        order.append(p)
        for q in left:
            if core[p] <= most and d[p, q] <= most:
                reach[q] = min(reach[q], max(core[p], d[p, q]))
    got = hierarchy.reachability_order(x, 4, most)
    assert got[0].tolist() == order and got[1].tolist() == reach[order].tolist()
