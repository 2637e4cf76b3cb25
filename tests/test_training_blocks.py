"""The differentiable system over blocks of some entities."""

import numpy as np
import pytest

from tessera.operators import training
from tessera.sources.shared import Rounds

SYSTEM = training.Settings(entry=0.5, stop=2.5, similarity=0.2, temperature=0.3, scale=2.0, most_leverage=0.2, turnover_penalty=0.1)


def test_cross_sections_across_blocks(spark, monkeypatch):
    """Blocks of few entities, some of them without rows at a time, give the sums of whole cross-sections."""
    r = np.random.default_rng(21)
    rows = []
    for t in [*range(3, 14), *range(16, 22)]:
        for i in range(30):
            if r.random() < 0.6 and not (t > 10 and i % 3 == 0):
                x = r.normal(size=4)
                rows.append((t, i, (x / np.linalg.norm(x)).tolist(), float(r.normal(0, 1.5)), float(r.normal(0, 0.03))))
    df = spark.createDataFrame(rows, "t int, i int, x array<double>, z double, ret double").repartition(3)
    centres = r.normal(size=(3, 4))
    whole = training.time_blocks(df, 5, Rounds(spark))
    monkeypatch.setattr(training, "ENTITIES", 4)
    parts = training.time_blocks(df, 5, Rounds(spark))
    assert max(x.entities for x in parts.collect()) < 20 < max(x.entities for x in whole.collect())
    assert training.sums_of(parts, centres, SYSTEM).tolist() == pytest.approx(training.sums_of(whole, centres, SYSTEM).tolist())
