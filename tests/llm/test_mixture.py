import random
import re
from collections import Counter
from fractions import Fraction

import pytest

from tessera.llm import mixture
from tessera.llm.shared import Scratch


def n_words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def exact_targets(sizes, weights=(5, 2, 1)):
    """Resharing in fractions."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, free, left = {}, set(order), Fraction(3, 2) * sum(sizes.values())
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 2 * sizes[s]}
        if not over:
            return target | {s: weight[s] * level for s in free}
        for s in over:
            target[s] = Fraction(2 * sizes[s])
            left -= target[s]
        free -= over
    return target


def table(spark, rows):
    return spark.createDataFrame([(i, t, s, 0, "k") for i, t, s in rows], "doc_id long, text string, source string, size int, key string")


def corpus(seed, n=400):
    r = random.Random(seed)
    text = lambda k: r.choice([" ", "\n", "\t ", "\x0b"]).join("w " for _ in range(k))
    names = [*(f"s{i}" for i in range(8)), "é", "\U0001f600", "￿", "", "Z"]
    rows = [(i, text(r.choice([0, 1, 5, 50, 700])), r.choice(names) if r.random() > 0.4 else "s3") for i in range(n)]
    rows += [(1000 + i, text(3), None) for i in range(9)] + [(None, text(40), "s1"), (None, text(40), "s1"), (None, None, None), (7, rows[7][1], rows[7][2]), (2000, "", "empty"), (2001, None, "empty"), (2002, "a", "one")]
    return rows


@pytest.mark.parametrize(("seed", "block"), [(1, 512), (2, 7), (3, 1)])
def test_op12(spark, seed, block):
    rows = corpus(seed, 400 if block > 1 else 60)
    got = mixture.mix_report(table(spark, rows).repartition(3), Scratch(spark), block=block).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, n_words(t)) for i, t, _ in rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += n_words(t)
    targets = exact_targets(sizes)
    assert abs(sum(targets.values()) - Fraction(3, 2) * sum(sizes.values())) == 0
    by_source = {}
    source = {i: s for i, _, s in rows if i is not None}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        if r.doc_id is not None:
            s = source[r.doc_id]
            assert r.source_size == sizes[s] and abs(r.target - float(targets[s])) <= 1e-9 * max(1.0, r.target)
            by_source[s] = by_source.get(s, 0) + r.taken
    for s, taken in by_source.items():
        if s not in (None, "s1"):  # these have rows without an id
            assert 0 <= targets[s] - taken < 1, s
    assert 0 <= sum(targets.values()) - sum(r.taken for r in got) < len(targets)


def test_reruns_agree(spark):
    rows = corpus(4)
    runs = [sorted(map(str, mixture.mix_report(table(spark, rows).repartition(n), Scratch(spark), block=16).collect())) for n in (1, 5)]
    assert runs[0] == runs[1]


@pytest.mark.parametrize("narrow", [False, True])
def test_schedule(spark, monkeypatch, narrow):
    """Slots fall to sources by low-discrepancy points: after any number of slots each source is
    within a few of its share; every slot of a source occurs once; pieces tile the taken words."""
    if narrow:
        monkeypatch.setattr(mixture, "RANGES", 4)
        monkeypatch.setattr(mixture, "CHUNK", 10)
    rows = corpus(5)
    scratch, block = Scratch(spark), 20
    sized = mixture.sized(table(spark, rows), scratch)
    every = mixture.sources(sized, scratch, block=block)
    of = {r.place: r for r in every.collect()}
    plan = sorted((r.slot, r.place, r["rank"]) for r in mixture.schedule(every, scratch).collect())
    n = sum(r.slots for r in of.values())
    assert len(plan) == n
    for place, r in of.items():
        assert sorted(k for _, p, k in plan if p == place) == list(range(r.slots))
    total = sum(r.quota for r in of.values())
    drawn = Counter()
    for slot in range(n):
        point = slot * mixture.GOLDEN % mixture.SPAN
        place = next(p for p, r in of.items() if r.low <= point < r.high)
        drawn[place] += 1
        assert drawn[place] > of[place].slots or (slot, place, drawn[place] - 1) in set(plan[max(0, slot - n) :])
        if slot % 97 == 0:
            assert all(abs(drawn[p] - (slot + 1) * r.quota / total) <= 4 for p, r in of.items())
    placed = scratch.cut(mixture.runs(sized, every), "placed")
    parts = mixture.pieces(placed, mixture.schedule(every, scratch), block).collect()
    filled = Counter()
    for p in parts:
        filled[p.slot, p.place, p["rank"]] += p.length
        assert p.length > 0 and p.start >= 0
    assert set(filled) == set(plan) and max(filled.values()) <= block
    assert sum(filled.values()) == total


def test_edges(spark):
    empty = table(spark, []).limit(0)
    assert mixture.mix_report(empty, Scratch(spark)).count() == 0
    none = mixture.mix_report(table(spark, [(1, "", "a"), (2, None, None)]), Scratch(spark)).collect()
    assert sorted(tuple(r) for r in none) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
    long = mixture.mix_report(table(spark, [(1, "w " * 300_000, "a"), (2, "x", "b")]), Scratch(spark)).collect()
    assert sorted(tuple(r) for r in long) == [(1, 300_000, 300_000, 449_999.5, 449_999), (2, 1, 1, 2.0, 2)]


def test_no_python(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = mixture.mix_report(docs, Scratch(spark))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|BroadcastNestedLoop", plan)
