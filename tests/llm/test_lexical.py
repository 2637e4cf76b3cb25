import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tessera.llm import lexical
from tessera.llm.shared import Scratch


def words_of(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def brute(docs, items, k):
    """Every document scored for every item."""
    rows = [(d, Counter(words_of(t))) for d, t in docs if words_of(t)]
    n_docs, length = len(rows), sum(sum(c.values()) for _, c in rows)
    df = Counter(t for _, c in rows for t in c)
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(words_of(t))
    out = []
    for i, terms in asked.items():
        found = []
        for d, c in rows:
            if d is not None:
                m = 100 - 90 + (90 * sum(c.values()) * n_docs) // length
                s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms if c[t])
                if s > 0:
                    found.append((-s, d))
        out += [(i, r, d, -s) for r, (s, d) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


def corpus(seed):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(30)] + ["Été", "été", "ÉTÉ", "I", "ß", "x y", "naïve", "日本", "\U0001f600", "A1b"]
    text = lambda n: r.choice([" ", "-", "\x00", "\x7f", "_"]).join(r.choice(vocab[: r.randrange(2, len(vocab))]) for _ in range(n))
    docs = [(i, text(r.choice([1, 3, 10, 60, 300]))) for i in range(150)]
    docs += [(200 + i, docs[7][1]) for i in range(60)] + [(300, None), (301, ""), (302, " -\t."), (None, docs[3][1]), (5, docs[9][1]), (5, docs[5][1]), (-4, docs[7][1])]
    items = [(i, text(r.choice([1, 4, 12, 40]))) for i in range(25)]
    items += [(100, None), (101, ""), (102, "zzz"), (103, docs[7][1]), (None, "w1"), (104, "w1"), (104, "w2 w3"), (105, "w1 w1 W1")]
    r.shuffle(docs)
    return docs, items


@pytest.mark.parametrize(("seed", "depth", "run", "pairs"), [(1, 32, 20_000, 100_000), (2, 1, 40, 30), (3, 3, 7, 1)])
def test_op11(spark, monkeypatch, seed, depth, run, pairs):
    for name, value in (("DEPTH", depth), ("DOCS_AT_ONCE", run), ("PAIRS_AT_ONCE", pairs)):
        monkeypatch.setattr(lexical, name, value)
    docs, items = corpus(seed)
    if pairs == 1:
        items = items[:3] + items[-6:]
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, term string, df int").repartition(3)
    q = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, block int").repartition(2)
    got = lexical.search(d, q, Scratch(spark), 10)
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert sorted(tuple(r) for r in got.collect()) == brute(docs, items, 10)


def test_empty(spark):
    d = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    q = spark.createDataFrame([(1, "a"), (2, "c"), (3, None)], "item_id long, text string")
    assert lexical.search(d.limit(0), q, Scratch(spark)).count() == 0
    assert lexical.search(d, q.limit(0), Scratch(spark)).count() == 0
    assert [tuple(r)[:3] for r in lexical.search(d, q, Scratch(spark)).collect()] == [(1, 1, 1)]


def test_long_text(spark):
    """A text of a million terms beside a short one."""
    long = " ".join(f"t{i % 5000}" for i in range(1_000_000))
    docs, items = [(1, long), (2, "t1 t2"), (3, "other")], [(7, "t1 t2 t3"), (8, long)]
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert sorted(tuple(r) for r in lexical.search(d, q, Scratch(spark)).collect()) == brute(docs, items, 10)


def run_of(n, n_terms, seed):
    r = np.random.default_rng(seed)
    doc = np.repeat(np.arange(n), n_terms)
    term = np.tile(np.arange(n_terms), n)
    impact = (r.pareto(1.2, len(doc)) * 1000).astype(np.int64)
    return lexical.Run(doc, term, impact, np.arange(n) * 3, n_terms), impact.reshape(n, n_terms).sum(axis=1)


def test_threshold_stops(monkeypatch):
    """Lists of few large impacts are not read to their ends, and the result is the whole one."""
    looked = []
    real = lexical.Run.scores
    monkeypatch.setattr(lexical.Run, "scores", lambda self, docs, wanted: looked.append(len(docs)) or real(self, docs, wanted))
    part, whole = run_of(5000, 3, 1)
    none = np.zeros(0, np.int64)
    ids, scores = part.search(np.arange(3), np.ones(3, bool), (none, none), 10)
    want = sorted((-int(s), 3 * i) for i, s in enumerate(whole))[:10]
    assert list(zip((-scores).tolist(), ids.tolist())) == want and sum(looked) < 1500
    looked.clear()  # what an earlier run found stops a later one at once
    part.search(np.arange(3), np.ones(3, bool), (none, none + 0) if False else (np.arange(10), np.full(10, 10**12)), 10)
    assert not looked


def test_ties_at_the_threshold():
    """The threshold stops strictly below: a later entry of equal score and smaller id gets in."""
    n = 100
    part = lexical.Run(np.arange(n), np.zeros(n, np.int64), np.full(n, 5), np.arange(n)[::-1].copy(), 1)
    ids, scores = part.search(np.arange(1), np.ones(1, bool), (np.zeros(0, np.int64),) * 2, 10)
    assert ids.tolist() == list(range(10)) and set(scores.tolist()) == {5}
