import random
import re
from itertools import permutations

import numpy as np
import pytest

from tessera.llm import audit
from tessera.llm.shared import Scratch


def brute(docs, labels):
    """Every order applied to every part's rows, one filter after another."""
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, x in labels if x == 1 and d is not None}
    marked = []
    for d, t, lang in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(w) < 100,
            "B": 100 * len(set(w)) < 80 * len(w),
            "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t),
            "D": any(c in "#$%&*|" for c in t),
            "E": d is not None and any(o is not None and o < d and (u or "") == t for o, u, _ in docs),
        }
        marked.append((lang or "", fails, d in good, d in toxic))
    out = {}
    for part in {m[0] for m in marked}:
        rows = [m for m in marked if m[0] == part]
        for order in permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order, 1):
                gone = [m for m in left if m[1][f]]
                left = [m for m in left if not m[1][f]]
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(m[1][f] for m in rows) - len(gone), sum(m[1][f] and sum(m[1].values()) == 1 for m in rows),
                    sum(m[2] for m in gone), sum(m[3] for m in gone),
                ]
    for (part, order, step), row in out.items():
        f = order[step - 1]
        row.append(sum(out[part, o, o.index(f) + 1][1] for o in map("".join, permutations("ABCDE"))))
    return sorted((*k, *v) for k, v in out.items())


def corpus(seed):
    r = random.Random(seed)
    word = lambda: r.choice(["alpha", "BETA", "été", "É", "a#b", "50%"] + [f"w{i}" for i in range(r.choice([3, 400]))])
    docs = []
    for i in range(160):
        words = [word() if r.random() < 0.05 else f"w{r.randrange(10**4)}" for _ in range(r.choice([0, 3, 99, 100, 150]))]
        if r.random() < 0.2:
            words = words[:10] * 12
        docs.append((i, r.choice([" ", "\n", "\x0c", " "]).join(words), r.choice(["en", "fr", "en", None, ""])))
    docs += [(500 + i, docs[3][1], "en") for i in range(40)] + [(-3, docs[3][1], "fr"), (None, docs[3][1], "en"), (None, docs[5][1], None), (600, None, "de"), (601, "", "de"), (3, docs[3][1], "en"), (8, docs[8][1], "xx")]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 0, 1, None])) for i in range(0, 160, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (9999, 1, 1)]
    return docs, labels


@pytest.mark.parametrize(("seed", "indexed"), [(1, 1 << 17), (2, 10)])
def test_op13(spark, monkeypatch, seed, indexed):
    monkeypatch.setattr(audit, "ROWS_INDEXED", indexed)
    docs, labels = corpus(seed)
    d = spark.createDataFrame([(*x, "q", 7) for x in docs], "doc_id long, text string, lang string, quality string, part int").repartition(3)
    x = spark.createDataFrame([(*x, "t") for x in labels], "doc_id long, quality int, toxic int, text string")
    got = audit.audit(d, x, Scratch(spark))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert {k for c, k in got.dtypes if c not in ("part", "filter_order", "step")} == {"bigint"}
    assert sorted(tuple(r) for r in got.collect()) == brute(docs, labels)


def test_edges(spark):
    d = spark.createDataFrame([(1, "a b", "en")], "doc_id long, text string, lang string")
    x = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(d.limit(0), x, Scratch(spark)).count() == 0
    got = audit.audit(d, x, Scratch(spark)).collect()
    assert len(got) == 600 and sum(r.removed for r in got) == 120 and {r.shapley for r in got if r.filter_order[r.step - 1] == "A"} == {120}
    long = spark.createDataFrame([(1, "w " * 500_000, "en"), (2, "w " * 500_000, "en")], "doc_id long, text string, lang string")
    got = {(r.filter_order, r.step): r.removed for r in audit.audit(long, x, Scratch(spark)).collect()}
    assert got["ABCDE", 2] == 2 and got["EBACD", 1] == 1 and got["EBACD", 2] == 1


def test_copies_of_a_hot_text(spark):
    """All rows but the first of a text fail, whatever the number of copies, ties of ids included."""
    d = spark.createDataFrame([(i // 2, b"x", 0, "p") for i in range(2000)] + [(9, b"y", 1, "p")], "id long, digest binary, bits int, part string")
    bits = audit.with_copies(d).groupBy("bits").count().collect()
    assert {r.bits: r["count"] for r in bits} == {0: 2, 16: 1998, 1: 1}


def test_bitmaps():
    r = np.random.default_rng(0)
    part, bits = r.integers(0, 7, 1000), r.integers(0, 32, 1000).astype(np.int32)
    part[part == 3] = 2
    good, toxic = r.random(1000) < 0.3, r.random(1000) < 0.1
    part = np.unique(part, return_inverse=True)[1]
    index = audit.BitmapIndex(part, 6, bits, good, toxic)
    for before, f, kept, removed, lost, bad in index.prefixes():
        gone = (bits & before) != 0
        mine = ~gone & (bits >> f & 1 != 0)
        for x, rows in ((kept, ~gone & ~mine), (removed, mine), (lost, mine & good), (bad, mine & toxic)):
            assert x.tolist() == np.bincount(part[rows], minlength=6).tolist()
