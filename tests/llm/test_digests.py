import hashlib
import unicodedata

from tessera.llm import digests
from tessera.llm.shared import Scratch

TEXTS = {7: "Hello  World", 6: "hello world ", 5: None, 4: "", 3: "ＨＥＬＬＯ world", 9: "Straße ﬁx é", 8: "STRASSE FIX é", 2: "😀" * 10, 1: "abc\n\tdef", 0: "x" * 3000}


def fold(t):
    x = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t or "").casefold())
    return " ".join(x.split())


def frame(spark, texts, extra=()):
    rows = [(d, t, 1, "h") for d, t in [*texts.items(), *extra]]
    return spark.createDataFrame(rows, "doc_id long, text string, n int, h1 string").repartition(3)


def brute(texts):
    order = sorted(texts, key=lambda d: (d is None, -(d or 0)))
    out = {}
    for i, d in enumerate(order):
        t, nxt = texts[d] or "", texts[order[(i + 1) % len(order)]] or ""
        k = len(t) // 3
        e = t[: len(t) - k] + nxt[:k]
        out[d] = (len(t), hashlib.sha256(e.encode()).hexdigest(), float(fold(e) == fold(t)), float(fold(t) == fold(nxt)), fold(t), fold(e))
    return out


def test_op8(spark):
    rows = digests.edit_report(frame(spark, TEXTS), Scratch(spark)).collect()
    want = brute(TEXTS)
    assert {r.doc_id: (r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in rows} == {d: w[:4] for d, w in want.items()}
    by = {}
    for r in rows:
        by.setdefault(want[r.doc_id][4], set()).add(r.fingerprint)
        by.setdefault(want[r.doc_id][5], set()).add(r.edited_fingerprint)
    assert all(len(v) == 1 for v in by.values())
    assert len({next(iter(v)) for v in by.values()}) == len(by)


def test_op8_edges(spark):
    assert digests.edit_report(frame(spark, TEXTS).limit(0), Scratch(spark)).count() == 0
    one = digests.edit_report(frame(spark, {1: "abcdef"}), Scratch(spark)).collect()
    assert len(one) == 1 and one[0].edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and one[0].near_next == 1.0
    rows = digests.edit_report(frame(spark, {3: "abc", None: "xyz"}, [(3, "abc"), (3, "abd")]), Scratch(spark)).collect()
    assert sorted((r.doc_id or -1, r.n_chars) for r in rows) == [(-1, 3), (3, 3), (3, 3), (3, 3)]


def test_collision_is_told_apart(spark, monkeypatch):
    from pyspark.sql import functions as F

    real = digests.wide_hash
    monkeypatch.setattr(digests, "wide_hash", lambda *c: (F.lit(1).cast("long"), F.lit(2).cast("long")) if len(c) == 1 else real(*c))
    rows = digests.edit_report(frame(spark, TEXTS), Scratch(spark)).collect()
    want = brute(TEXTS)
    assert {r.doc_id: (r.near_edited, r.near_next) for r in rows} == {d: w[2:4] for d, w in want.items()}
    assert len({r.fingerprint for r in rows}) == len({w[4] for w in want.values()})
    marks = {r.fingerprint: want[r.doc_id][4] for r in rows}
    assert all(marks.get(r.edited_fingerprint, want[r.doc_id][5]) == want[r.doc_id][5] for r in rows)
    groups = digests.exact_groups(frame(spark, TEXTS), Scratch(spark)).collect()
    assert len({r.fingerprint for r in groups}) == len({fold(t) for t in TEXTS.values()})


def test_repeated_rows(spark):
    """Many copies of one text, and many repeats of one row."""
    texts = {d: "the same text of all" for d in range(300)}
    rows = digests.edit_report(frame(spark, texts, [(7, texts[7])] * 2500), Scratch(spark)).collect()
    assert len(rows) == 2800 and sum(r.doc_id == 7 for r in rows) == 2501
    assert len({r.fingerprint for r in rows}) == 1 and all(r.near_next == 1.0 for r in rows)


def test_groups(spark):
    rows = digests.exact_groups(frame(spark, TEXTS, [(7, "Hello  World")]), Scratch(spark)).collect()
    smallest, size = {}, {}
    every = [*TEXTS.items(), (7, "Hello  World")]
    for d, t in every:
        smallest[fold(t)] = min(d, smallest.get(fold(t), d))
        size[fold(t)] = size.get(fold(t), 0) + 1
    assert sorted((r.doc_id, r.group_id, r.group_size) for r in rows) == sorted((d, smallest[fold(t)], size[fold(t)]) for d, t in every)
