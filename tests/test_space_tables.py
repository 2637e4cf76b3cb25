"""What density clusters leave on disk."""

from pathlib import Path
from urllib.parse import urlparse

import numpy as np

from tessera.operators import clustering
from tessera.sources import shared


def test_searches_leave_the_vectors_once(spark, monkeypatch):
    made, init = [], shared.Rounds.__init__
    monkeypatch.setattr(shared.Rounds, "__init__", lambda self, s: init(self, s) or made.append(self.root))
    x = np.random.default_rng(2).normal(0, 1, (3000, 32))
    df = spark.createDataFrame([(i, i % 2, v.tolist()) for i, v in enumerate(x)], "id int, g int, v array<double>").repartition(4)
    assert clustering.dbscan(df, ["g"]).count() == 3000
    left = sum(f.stat().st_size for root in made for f in Path(urlparse(root).path).rglob("*.parquet"))
    assert x.nbytes / 2 < left < 1.6 * x.nbytes
