import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import simhash
from tessera.llm.components import connected
from tessera.llm.shared import Scratch


def brute_mark(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    marks = [brute_mark(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (marks[i] ^ marks[j]).bit_count() <= 2 and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    least = {}
    for (d, _), x in zip(rows, label):
        if d is not None:
            least[x] = min(d, least.get(x, d))
    return sorted(((d is not None, d or 0, f"{m:016x}", least.get(x)) for (d, _), m, x in zip(rows, marks, label)), key=repr)


def texts(seed):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)] + ["Été", "ß", "A b"]
    base = [[r.choice(vocab) for _ in range(r.choice([0, 1, 2, 3, 5, 40, 300]))] for _ in range(60)]
    out = []
    for words in base:
        out.append(r.choice([" ", "  ", "\n", "\x0b"]).join(words))
        for _ in range(r.choice([0, 1, 3])):
            w = list(words)
            if w:
                w[r.randrange(len(w))] = r.choice(vocab)
            out.append(" ".join(w).upper() if r.random() < 0.3 else " ".join(w))
    return [None, "", " \t", *out]


def test_op2(spark):
    rows = list(enumerate(texts(1))) + [(None, "no id at all"), (None, ""), (5, texts(1)[5]), (-7, texts(1)[9])]
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, id int, fp int").repartition(3)
    got = simhash.components(df, Scratch(spark)).collect()
    assert sorted(((r.doc_id is not None, r.doc_id or 0, r.fingerprint, r.component_id) for r in got), key=repr) == brute_components(rows)
    assert simhash.components(df.limit(0), Scratch(spark)).count() == 0


def test_links_are_exact(spark):
    r = random.Random(2)
    marks = set()
    for _ in range(40):
        x = r.getrandbits(64)
        for _ in range(r.choice([1, 2, 12])):
            marks.add(x)
            for _ in range(r.choice([1, 2, 2, 3])):
                x ^= 1 << r.randrange(64)
    marks |= {0, 1, (1 << 64) - 1, 1 << 63}
    df = spark.createDataFrame([(simhash._signed(m),) for m in marks], "fp long")
    got = {row.node: row.root for row in connected(simhash.close_pairs(df, Scratch(spark)), Scratch(spark)).collect()}
    label = {m: m for m in marks}
    for a in marks:
        for b in marks:
            if (a ^ b).bit_count() <= 2 and label[a] != label[b]:
                old, new = label[a], label[b]
                label = {m: new if x == old else x for m, x in label.items()}
    groups = {}
    for m, x in label.items():
        groups.setdefault(x, set()).add(simhash._signed(m))
    want = {m: min(g) for g in groups.values() if len(g) > 1 for m in g}
    assert got == want


def test_grid_is_the_manhattan_ball(spark):
    r = random.Random(6)
    marks = [0, (1 << 64) - 1, *(r.getrandbits(64) for _ in range(20))]
    df = spark.createDataFrame([(simhash._signed(m),) for m in marks], "fp long")
    df = df.select("fp", simhash.segment_counts(df.fp).alias("c"))

    def digits(x):
        return tuple((x >> 2 * i) & 3 for i in range(32))

    for row in df.select("fp", "c", simhash._around(df.c).alias("near")).collect():
        bits = row.fp & (1 << 64) - 1
        here = digits(row.c & (1 << 64) - 1)
        assert here == tuple((bits >> 2 * i & 1) + (bits >> 2 * i + 1 & 1) for i in range(32))
        want = {here} | {(*here[:i], here[i] + s, *here[i + 1 :]) for i in range(32) for s in (-1, 1) if 0 <= here[i] + s <= 2}
        assert {digits(x & (1 << 64) - 1) for x in row.near} == want and len(row.near) == len(want)


@pytest.mark.parametrize("shape", ["path", "star", "random", "none"])
def test_connected(spark, shape):
    r = random.Random(3)
    edges = {"path": [(i, i + 1) for i in range(60)], "star": [(99, i) for i in range(50)], "none": [(4, 4)], "random": [(r.randrange(300), r.randrange(300)) for _ in range(200)]}[shape]
    got = {x.node: x.root for x in connected(spark.createDataFrame(edges, "a long, b long"), Scratch(spark)).collect()}
    label = {}
    for a, b in edges:
        if a != b:
            x, y = label.setdefault(a, {a}), label.setdefault(b, {b})
            if x is not y:
                x |= y
                for m in y:
                    label[m] = x
    assert got == {m: min(g) for m, g in label.items()}


def test_near_duplicates(spark):
    r = random.Random(4)
    docs, copies = [], {}
    for i in range(150):
        words = [f"v{r.randrange(3000)}" for _ in range(r.choice([60, 300, 900]))]
        docs.append((10 * i, " ".join(words)))
        if i % 3 == 0:
            for k in range(1, r.choice([2, 4])):
                w = list(words)
                for at in range(r.randrange(60), len(w), 100):
                    w[at] = "other"
                docs.append((10 * i + k, " ".join(w)))
                copies[10 * i + k] = 10 * i
    docs += [(None, "x"), (7777, None), (7778, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {x.doc_id: x.component_id for x in simhash.near_duplicates(df, Scratch(spark)).collect()}
    assert {d for d, c in got.items() if d != c} == {*copies, 7778}
    assert all(got[d] == c for d, c in copies.items()) and got[7778] == 7777
    assert simhash.near_duplicates(df.limit(0), Scratch(spark)).count() == 0


def jaccard(a, b):
    x, y = (set(simhash.shingle_hashes(t, 5).tolist()) for t in (a, b))
    return len(x & y) / len(x | y)


def test_similarity_is_exact(spark):
    """Pairs just below the line are told from pairs just above it, which no estimate does."""
    r = random.Random(8)
    docs, below, above = [], set(), set()
    for i in range(60):
        words = [f"v{r.randrange(10**6)}" for _ in range(404)]
        other = list(words)
        for at in range(5, 5 * (8, 11, 13)[i % 3], 5):  # each word replaced apart changes five shingles
            other[at] = "other"
        docs += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
        like = jaccard(docs[-2][1], docs[-1][1])
        if 0.7 < like < 0.8:
            below.add(2 * i + 1)
        if like >= 0.82:
            above.add(2 * i + 1)
    assert len(below) >= 20 and len(above) == 20
    got = simhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), Scratch(spark)).collect()
    gone = {x.doc_id for x in got if x.doc_id != x.component_id}
    assert not gone & below and len(gone & above) >= 0.9 * len(above)


def test_all_that_meet_are_compared(spark):
    """Whatever the ids: every pair of different roots within two bits of a band is a pair alone
    in a cell, or both are in the crowd, which is joined without loss."""
    r = random.Random(9)
    values = [0, 1, 3, 7, 0, 1, 1 << 20, 0, 5, 1 << 20, 0, *(r.getrandbits(30) for _ in range(20))]
    values += [v ^ 1 << r.randrange(30) for v in values[-9:]] + [values[-1] ^ 3]
    rows = [(i + 1, i % 4, 9, v, *[0] * 11) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "id long, root long, n long, " + ", ".join(f"f{i} long" for i in range(12)))
    pairs, crowd = simhash._meetings(df, [(0, simhash._band(0))], Scratch(spark))
    pairs, crowd = {(x.a, x.b) for x in pairs.collect()}, {x.id for x in crowd.collect()}
    meet = {(x[0], y[0]) for x in rows for y in rows if x[0] < y[0] and x[1] != y[1] and (x[3] ^ y[3]).bit_count() <= 2}
    assert pairs <= meet and pairs and all(p in pairs or crowd >= set(p) for p in meet)


@pytest.mark.parametrize("seed", [1, 2])
def test_rare_pairs_lose_nothing(spark, seed):
    r = random.Random(seed)
    sets = [r.sample(range(60), r.randrange(1, 40)) for _ in range(40)]
    sets += [[x for x in r.choice(sets) if r.random() > 0.1] + r.sample(range(60, 500), 2) for _ in range(160)]
    sets = [sorted(set(x)) for x in sets if x]
    rows = [(i, x, i % 7) for i, x in enumerate(sets)]
    df = spark.createDataFrame(rows, "id long, set array<long>, root long")
    got = {(x.a, x.b) for x in simhash._rare_pairs(df.select("id", "set"), df.select("id", "root"), 0.8).collect()}
    like = {(a, b) for a, x, p in rows for b, y, q in rows if a < b and p != q and len(set(x) & set(y)) >= 0.8 * len(set(x) | set(y))}
    assert like and like <= got and len(got) < 0.2 * len(rows) ** 2


def test_mates_cost_their_number(spark):
    """A document meets one of another root with its band value, if there is any."""
    r = random.Random(10)
    rows = [(i, r.choice([1, 1, 1, 2, 3]), 9, r.choice([5, 6]), *[0] * 11) for i in range(60)] + [(100, 7, 9, 8, *[0] * 11), (101, 7, 9, 8, *[0] * 11)]
    df = spark.createDataFrame(rows, "id long, root long, n long, " + ", ".join(f"f{i} long" for i in range(12)))
    root, value = {x[0]: x[1] for x in rows}, {x[0]: x[3] for x in rows}
    pairs = [(x.a, x.b) for x in simhash._mates(df, [(0, simhash._band(0))], 0).collect()]
    assert all(root[a] != root[b] and value[a] == value[b] for a, b in pairs)
    assert {x for p in pairs for x in p} >= {x[0] for x in rows if x[3] in (5, 6) and x[1] != 1} and len(pairs) <= 60


def test_copies_inside_a_family(spark):
    """Texts that share a template, at 0.70 of one another, and a near copy at 0.88 of each."""
    template = [f"t{i}" for i in range(330)]
    docs = []
    for i in range(150):
        own = [f"o{i}x{k}" for k in range(65)]
        copy = [f"c{i}" if k % 12 == 5 else x for k, x in enumerate(own)]
        docs += [(i, " ".join(template + own)), (150 + i, " ".join(template + copy))]
    assert jaccard(docs[0][1], docs[2][1]) < 0.75 and 0.87 < jaccard(docs[0][1], docs[1][1]) < 0.9
    got = simhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), Scratch(spark)).collect()
    assert {x.doc_id: x.component_id for x in got} == {d: d % 150 for d, _ in docs}


def test_a_template_makes_no_pairs(spark):
    """Sets that share 86 of 100 shingles, at 0.75 of one another, do not meet at the template's."""
    n = 3000
    rows = [(i, [*range(86), *range(1000 + 14 * i, 1014 + 14 * i)], i) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, set array<long>, root long")
    assert simhash._rare_pairs(df.select("id", "set"), df.select("id", "root"), 0.8).count() == 0


@pytest.mark.parametrize("pages", [100, 1500, 10_000])
def test_recall_in_families(spark, pages):
    """Pages of one template, at 0.54 of one another, half of them with a partner at 0.80 to 0.90:
    recall does not fall with the size of the family, and nothing else is linked."""
    r = random.Random(pages)
    template = [f"t{i}" for i in range(210)]
    docs, wanted = [], set()
    for i in range(pages // 2):
        own = [f"o{i}x{k}" for k in range(90)]
        copy = [f"c{i}x{k}" if k % 18 < r.choice([1, 2]) else x for k, x in enumerate(own)]
        docs += [(i, " ".join(template + own)), (pages + i, " ".join(template + copy))]
        if jaccard(docs[-2][1], docs[-1][1]) >= 0.8:
            wanted.add(pages + i)
    assert 0.5 < jaccard(docs[0][1], docs[2][1]) < 0.58 and len(wanted) > pages // 4
    got = {x.doc_id: x.component_id for x in simhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), Scratch(spark)).collect()}
    linked = {d for d, c in got.items() if d != c}
    assert linked <= wanted and all(got[d] == d - pages for d in linked)
    assert len(linked) >= 0.95 * len(wanted)


def test_bands_share_no_bit(spark):
    """The bands read each bit of the fingerprint once at most; their number is fixed."""
    bands = simhash.banding(0.8, 0.97)
    assert simhash.lanes_of(bands) <= 12
    whole = [0] * 12
    for k in range(bands):
        for bit in range(k * simhash.BAND_BITS, (k + 1) * simhash.BAND_BITS):
            f = list(whole)
            f[bit // 64] = simhash._signed(1 << bit % 64)
            row = spark.range(1).select(*(F.lit(x).cast("long").alias(f"f{i}") for i, x in enumerate(f)))
            if bit % 7 == 0:
                values = row.select(*(simhash._band(j).alias(f"b{j}") for j in range(bands))).first()
                assert [j for j in range(bands) if values[j]] == [k]


def test_repeated_rows(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(50)) for x in "abc")
    docs = [(1, a), (5, a), (4, b), (4, c), (9, b), (9, b), (6, c), (7, "x")]
    got = simhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), Scratch(spark)).collect()
    assert sorted((x.doc_id, x.component_id) for x in got) == [(1, 1), (4, 4), (4, 4), (5, 1), (6, 4), (7, 7), (9, 4), (9, 4)]
