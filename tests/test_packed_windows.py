"""Steps of k-means over packed windows."""

import numpy as np
import pytest

from tessera.operators import window_models
from tessera.sources.shared import Rounds


def test_packed_means_are_those_of_the_rows(spark, monkeypatch):
    monkeypatch.setattr(window_models, "PACK", 7)
    r = np.random.default_rng(4)
    rows = [(w, i, r.normal(0, 1, 3).round(2).tolist()) for w in ("a", "b", "c") for i in range({"a": 50, "b": 9, "c": 2}[w])]
    df = spark.createDataFrame(rows, "w string, id int, v array<double>").repartition(3)
    centres = Rounds(spark).cut(window_models.first_centres(df, ["w"], 3, 4, 5))
    got = {(x.w, x.start, x.cluster): x for x in window_models.packed_means(window_models.packed(df, ["w"]), centres, ["w"]).collect()}
    near = {}
    for x in window_models.assign(df, centres, ["w"]).collect():
        near.setdefault((x.w, x.start, x.cluster), []).append((x.v, x.cost))
    assert got.keys() == near.keys()
    for key, some in near.items():
        assert got[key].n == len(some) and got[key].cost == pytest.approx(sum(c for _, c in some))
        assert got[key]["mean"] == pytest.approx(np.mean([v for v, _ in some], axis=0).tolist())
