import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import line_dedup as ld
from tessera.llm.shared import Scratch


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 9), max_size=30), st.lists(st.integers(1, 9), max_size=30))
def test_patience_is_an_alignment(a, b):
    m = ld.patience(a, b)
    assert all(a[i] == b[j] for i, j in m)
    assert all(p < r and q < s for (p, q), (r, s) in zip(m, m[1:]))
    once = [x for x in a if a.count(x) == 1 and b.count(x) == 1]
    if len(once) == 1:
        assert any(a[i] == once[0] for i, _ in m) or (a and b and (a[0] == b[0] or a[-1] == b[-1]))


def test_patience_keeps_order():
    assert ld.patience([1, 2, 3, 9, 4, 5], [1, 2, 3, 4, 5]) == [(0, 0), (1, 1), (2, 2), (4, 3), (5, 4)]
    assert ld.patience([], [1]) == [] and ld.patience([7, 1, 2, 3, 8], [9, 1, 2, 3, 6]) == [(1, 1), (2, 2), (3, 3)]


def words(r, n):
    return " ".join(f"w{r.randrange(10**6)}" for _ in range(n))


def brute(rows, min_words):
    """All pairs, no function of the module: a line goes if some run of filled lines around it has
    the words and is a run of an earlier document's filled lines."""
    docs = sorted((d, t) for d, t in rows if d is not None and t is not None)
    runs, out = {}, {}
    for d, t in docs:
        lines = [" ".join(x.split()) for x in t.split("\n")]
        filled = [i for i, x in enumerate(lines) if x]
        mine, gone = {}, set()
        for i in range(len(filled)):
            total = 0
            for j in range(i, min(len(filled), i + 70)):
                total += len(lines[filled[j]].split())
                if total >= min_words:
                    mine.setdefault("\n".join(lines[k] for k in filled[i : j + 1]), []).append((filled[i], filled[j]))
        for run, places in mine.items():
            if runs.get(run, d) < d:
                for a, b in places:
                    gone |= set(range(a, b + 1))
            runs.setdefault(run, d)
        out[d] = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone)
    return out


def corpus(seed):
    r = random.Random(seed)
    passages = ["\n".join(words(r, k) for k in ks) for ks in ([60], [20, 20, 20], [10, 1, 45], [5] * 12)]
    short = ["\n".join([words(r, 10)] * 2), words(r, 30), "The.", ""]
    rows = []
    for d in range(80):
        parts = [words(r, r.randrange(1, 30)) for _ in range(r.randrange(1, 6))]
        for p in r.sample(passages, r.choice([0, 0, 1, 2])) + r.sample(short, 2):
            parts.insert(r.randrange(len(parts) + 1), p)
        rows.append((d, "\n".join(parts)))
    rows += [(100, rows[3][1]), (101, rows[3][1] + "\nextra line"), (102, None), (103, ""), (None, rows[3][1]), (105, passages[3] + "\nbetween\n" + passages[0] + "\n" + passages[3]), (104, "\n\n" + passages[1].replace("\n", "\n \n") + "\n")]
    r.shuffle(rows)
    return rows, passages


@pytest.mark.parametrize("seed", [1, 2])
def test_op5(spark, seed):
    rows, passages = corpus(seed)
    df = spark.createDataFrame([(d, t, 0, "a") for d, t in rows], "doc_id long, text string, n_lines int, hashes string").repartition(4)
    got = ld.line_dedup(df, Scratch(spark))
    assert got.columns == ["doc_id", "text", "hashes", "n_lines", "n_removed"]
    want = brute(rows, 50)
    found = got.collect()
    assert len(found) == len(rows)
    for r in found:
        text = dict((d, t) for d, t in rows)[r.doc_id]
        if r.doc_id is None or text is None:
            assert r.text == text and r.n_removed == 0
        else:
            assert r.text == want[r.doc_id]
            assert r.n_lines == text.count("\n") + 1
            assert r.n_removed == r.n_lines - (r.text.count("\n") + 1) or (r.text == "" and r.n_removed in (r.n_lines, r.n_lines - 1))
    for p in passages:
        first = min(d for d, t in rows if d is not None and t and p in t)
        assert [r.doc_id for r in found if r.doc_id is not None and r.text and p in r.text] == [first]
    texts = {r.doc_id: r.text for r in found}
    assert texts[100] == "" and texts[105] == "between"


@pytest.mark.parametrize("seed", range(4))
def test_all_pairs(spark, seed):
    """Documents of few kinds of lines, so that blocks overlap, move, repeat and nest."""
    r = random.Random(seed)
    kinds = [words(r, k) for k in (60, 30, 25, 25, 20, 12, 12, 8, 5, 3, 1, 1)]
    rows = [(d, "\n".join(r.choice([*kinds, ""]) if r.random() < 0.8 else words(r, 9) for _ in range(r.randrange(0, 9)))) for d in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {x.doc_id: x.text for x in ld.line_dedup(df, Scratch(spark)).collect()} == brute(rows, 50)


def test_blocks_of_later_documents(spark):
    """Documents 3 and 4 share a block whose parts occurred in others before; 6 has it moved."""
    a, b, c = (words(random.Random(i), 20) for i in range(3))
    x, y, z, v, w = (words(random.Random(10 + i), 30) for i in range(5))
    rows = [(1, f"{a}\n{b}"), (2, f"{b}\n{c}"), (3, f"{a}\n{b}\n{c}"), (4, f"{a}\n{b}\n{c}"), (5, "\n".join((x, z, x, y, v))), (6, "\n".join((x, y, w)))]
    got = {r.doc_id: r.text for r in ld.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark)).collect()}
    assert got == dict(rows) | {4: "", 6: w}


def test_nothing_goes_without_an_alignment(spark, monkeypatch):
    """Both documents share a block in place, a moved one and a repeated one; all of them go by way
    of the alignment alone."""
    r = random.Random(5)
    a, b, c = ([words(r, 30), words(r, 30)] for _ in range(3))
    own = [words(r, 9) for _ in range(3)]
    counts = [30] * 4 + [9] + [30] * 2
    earlier, later = [*a, *b, own[0], *c], [*c, own[1], *a, *a, own[2], *b]
    number = {x: i + 1 for i, x in enumerate({*earlier, *later})}
    args = ([number[x] for x in later], [30, 30, 9, 30, 30, 30, 30, 9, 30, 30], [number[x] for x in earlier], counts, 50)
    assert ld.shared_blocks(*args) == [(0, 2), (3, 5), (5, 7), (8, 10)]
    monkeypatch.setattr(ld, "patience", lambda a, b: [])
    assert ld.shared_blocks(*args) == []


def test_windows_are_filed_under_their_rarest_line():
    lines, counts = [11, 12, 13, 14, 21, 22], [30, 30, 5, 30, 60, 1]
    got = ld.anchors([0, 1, 2, 3, 7, 8], lines, counts, [9, 2, 2, 5, 3, 4], 50)
    assert {r for r, _ in got} == {12, 21} and len(got) == len(set(got)) == 5
    again = ld.anchors([5, 6, 7], lines[1:4], counts[1:4], [2, 2, 5], 50)
    assert set(again) < set(got)


def test_long_repetitive_texts_take_linear_time():
    import time

    def run(n):
        lines = [i % 7 + 1 for i in range(n)]
        start = time.perf_counter()
        assert ld.shared_blocks(lines, [9] * n, lines[3:] + lines[:3], [9] * n, 50) == [(0, n)]
        return time.perf_counter() - start

    run(1000)
    assert run(64000) < 40 * max(run(4000), 0.01)


def test_op5_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ld.line_dedup(empty, Scratch(spark)).count() == 0
    long = "\n".join(f"line {i % 977} of a long text with words" for i in range(20000))
    df = spark.createDataFrame([(1, long), (2, long), (2, "other"), (2, "other")], "doc_id long, text string")
    got = sorted((r.doc_id, r.text) for r in ld.line_dedup(df, Scratch(spark)).collect())
    assert got == [(1, long), (2, ""), (2, "other"), (2, "other")]
