import random
import re

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import language, quotes
from tessera.llm.shared import Scratch


def test_language_held_out(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    train, test = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")
    model = language.fit(train)
    assert model.languages == ["de", "en", "es", "fr"]
    blind = test.withColumn("none", F.lit(None).cast("string"))
    rows = language.identify(blind, model, Scratch(spark), ["doc_id", "lang"], "text", "none", "none").toDF("doc_id", "truth", "lang", "posterior", "accepted").collect()
    assert len(rows) == test.count()
    assert sum(r.truth == r.lang for r in rows) >= 0.98 * len(rows)
    assert sum(r.accepted for r in rows) >= 0.98 * len(rows)


def test_language_fusion_and_edges(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language.fit(docs)
    fr = next(r.text for r in docs.where("lang = 'fr'").limit(1).collect())
    odd = [(0, None, None, None), (1, "", "", "xx"), (2, "%%% 123 ###", "a.example.net", "fr"), (3, fr, "b.example.org", None), (None, fr, "b.example.org", "de"), (3, fr, "b.example.org", None), (9, "a", "only.fr.example.com", "fr"), (10, fr * 500, "x", "fr")]
    odd += [(100 + i, fr[:200], "only.fr.example.com", "fr") for i in range(60)]
    df = spark.createDataFrame([(*x, "v", 1) for x in odd], "doc_id long, text string, source string, lang string, host string, best int")
    out = language.identify(df, model, Scratch(spark), ["doc_id", "source"], "text", "source", "lang").collect()
    assert len(out) == len(odd)
    by = {r.doc_id: r for r in out if r.doc_id is not None}
    assert not by[0].accepted and not by[1].accepted and not by[2].accepted
    assert by[3].lang == "fr" and by[3].accepted and by[10].lang == "fr"
    assert by[9].lang == "fr" and by[9].accepted  # one letter: the host and the declaration decide
    kept = language.keep_identified(docs.unionByName(df.select("doc_id", "text", "lang", "source"), allowMissingColumns=True), Scratch(spark))
    assert kept.columns == docs.columns
    assert kept.where("doc_id < 3 and n_chars is null").count() == 0
    assert kept.where("n_chars is not null").count() >= 0.98 * docs.count()
    none = language.identify(df.limit(0), model, Scratch(spark), ["doc_id"], "text", "source", "lang")
    assert none.count() == 0


def test_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    model = language.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    rows = language.identify_pages(pages, model, Scratch(spark)).collect()
    assert len(rows) == pages.count()
    assert sum(r.lang == r.declared for r in rows) >= 0.9 * sum(r.declared != "" for r in rows)
    html = spark.createDataFrame([("<HTML class=a LANG='De'><style>p</style>x &amp; <b>y</b><script>z</script>",)], "h string")
    assert html.select(language.declared_language(F.col("h")), language.visible_text(F.col("h"))).first()[0] == "de"
    assert html.select(language.visible_text(F.col("h"))).first()[0].split() == ["x", "y"]


def test_fusion_by_brute_force(spark):
    """Counts, smoothing and fusion in numpy, from the texts' scores."""
    r = random.Random(3)
    words = {"aa": "lorem ipsum dolor amet", "bb": "wxyz kjqv zzkw qvxj", "ccc": "mnop rstu ghij bcde"}
    said = lambda x, n: " ".join(r.choice(words[x].split()) for _ in range(n))
    train = spark.createDataFrame([(i, said(x, 30), x) for i, x in enumerate(list(words) * 10)], "doc_id long, text string, lang string")
    model = language.fit(train)
    assert model.languages == ["aa", "bb", "ccc"]
    rows = []
    for i in range(200):
        x = r.choice(list(words))
        host = r.choice(["a.one.net", "b.one.net", "two.net", "x.org", "plain", ""])
        rows.append((i, said(x, r.choice([0, 1, 1, 2])), host, r.choice([x, x, "aa-US", "ccc", "fr", "", None])))
    df = spark.createDataFrame(rows, "doc_id long, text string, host string, declared string").repartition(3)
    got = {x.doc_id: x for x in language.identify(df, model, Scratch(spark), ["doc_id"], "text", "host", "declared").collect()}

    scores = []
    for _, text, _, _ in rows:
        b = language._buckets(text.encode())
        scores.append(np.append(model.scores[b].sum(axis=0, dtype=np.float64), -len(b) * np.log(language.BUCKETS)) * language.WEIGHT)
    best = [int(x.argmax()) for x in scores]
    index = [{"aa": 0, "bb": 1, "ccc": 2}.get((d or "").split("-")[0], -1) for *_, d in rows]
    seen = np.zeros((4, 3)) + 1.0 + 8.0 * np.eye(4, 3)
    for b, d in zip(best, index):
        if d >= 0:
            seen[b, d] += 1
    says = np.log(seen / seen.sum(axis=1, keepdims=True))
    part = lambda h, n: ".".join(h.split(".")[-n:]) if n else h
    for at, (i, text, host, _) in enumerate(rows):
        p = np.bincount(best, minlength=4) + np.array([1, 1, 1, language.NONE_WEIGHT])
        p = p / p.sum()
        for n in (1, 2, 0):
            c = np.bincount([b for j, b in enumerate(best) if j != at and part(rows[j][2], n) == part(host, n)], minlength=4)
            p = (c + language.PSEUDO * p) / (c.sum() + language.PSEUDO)
        total = scores[at] + np.log(p) + (says[:, index[at]] if index[at] >= 0 else 0)
        post = np.exp(total - total.max())
        post /= post.sum()
        assert got[i].lang == model.languages[int(total[:3].argmax())] and abs(got[i].posterior - post[:3].max()) < 1e-9
        assert got[i].accepted == (post[:3].max() >= 0.5 and text != "")


def test_other_languages_and_noise(spark, sf_dir):
    model = language.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    odd = ["Все счастливые семьи похожи друг на друга, каждая несчастливая семья несчастлива", "吾輩は猫である。名前はまだ無い。どこで生れたか", "xq zzkjw qpwx vbnq jjkq wwxz pqzx kkjv qqxz bvvw zxqj"]
    df = spark.createDataFrame([(i, t * 5, None, None) for i, t in enumerate(odd)], "doc_id long, text string, source string, lang string")
    assert not any(r.accepted for r in language.identify(df, model, Scratch(spark), ["doc_id"], "text", "source", "lang").collect())


def test_every_labelled_language_and_none(spark):
    r = random.Random(4)
    rows = [(i, " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}{r.choice('xyz')}" for _ in range(40)), f"l{i % 90:02}") for i in range(180)]
    df = spark.createDataFrame([(*x, "s", len(x[1])) for x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert len(language.fit(df).languages) == 90
    assert language.keep_identified(df.limit(0), Scratch(spark)).count() == 0
    bare = df.withColumn("lang", F.lit(None).cast("string"))
    assert language.fit(bare).languages == [] and language.fit(bare.limit(0)).languages == []
    odd = bare.union(spark.createDataFrame([(500, "12 34", None, "s", 5), (501, None, None, None, None)], bare.schema))
    assert language.keep_identified(odd, Scratch(spark)).count() == 180
    none = language.identify(bare, language.fit(bare), Scratch(spark), ["doc_id"], "text", "source", "lang")
    assert none.where("lang is null and posterior is null and not accepted").count() == 180


def test_three_letter_codes(spark):
    said = ["eng", "en-GB", "EST", "fry", "fre", "fra", "deu", "ger", "frx", "english", "fr_FR", "", None]
    df = spark.createDataFrame([(x,) for x in said], "d string").coalesce(1)
    got = [r[0] for r in df.select(language._language_index(F.col("d"), ["de", "en", "es", "fr"])).collect()]
    assert got == [1, 1, -1, -1, 3, 3, 0, 0, -1, -1, 3, -1, -1]


MARKS = re.compile(r"^[ \t]*(>[ \t]?)+")


def fold(t):
    return " ".join(t.lower().split())


def brute(rows):
    parsed = []
    for c, t, role, text in rows:
        runs = []
        for line in re.split(r"\r?\n", text or ""):
            m = MARKS.match(line)
            level, body = (m.group().count(">"), line[m.end() :]) if m else (0, line)
            if runs and runs[-1][0] == level:
                runs[-1][1].append(body)
            else:
                runs.append((level, [body]))
        own = [re.sub(r"^\s+|\s+$", "", "\n".join(b)) for lv, b in runs if lv == 0]
        quoted = [(lv, fold("\n".join(b)), [fold(x) for x in b if fold(x)]) for lv, b in runs if lv and fold("\n".join(b))]
        said = [["\n".join(b), [fold(x) for x in b if fold(x)]] for lv, b in runs if lv == 0]
        parsed.append((c, t, role, "\n".join(x for x in own if x), quoted, said))

    def has(message, text, lines):
        """Whether a message says this: as a whole, passage or paragraph, or as lines in a row."""
        texts = [message[3], *(x for x, _ in message[5])]
        if text in {fold(x) for t in texts for x in [t, *re.split(r"\n\s*\n", t)]}:
            return True
        return any(own[i : i + len(lines)] == lines for _, own in message[5] for i in range(len(own)))

    numbered = [m for m in parsed if m[0] is not None and m[1] is not None]
    out, links, ups = [], {}, {}
    for c, t, role, body, quoted, _ in parsed:
        best, linked = None, 0
        for at, (lv, text, lines) in enumerate(quoted if c is not None and t is not None else []):
            where = [(m[0], m[1]) for m in numbered if has(m, text, lines)]
            near = [x for x in where if x[0] == c and x[1] < t]
            far = [x for x in where if x < (c, t)]
            o = min(near) if near else min(far) if far else None
            if o:
                linked += 1
                best = min(best or (lv, at, o), (lv, at, o))
                if o[0] != c:
                    links.setdefault(c, set()).add(o[0])
                    links.setdefault(o[0], set()).add(c)
        if best and best[2][0] != c:
            ups[c] = min(ups.get(c, (t, best[2])), (t, best[2]))
        n = len(quoted) if c is not None and t is not None else 0
        out.append((c, t, role, body, best and best[2][0], best and best[2][1], n, linked))
    thread = {}
    for c in sorted({r[0] for r in rows if r[0] is not None}):
        seen, todo = set(), [c]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += links.get(x, ())
        thread[c] = min(seen)

    def walk(c):  # a conversation's messages, each followed by the conversations that reply to it
        for t in sorted({r[1] for r in rows if r[0] == c}, key=lambda t: (t is None, t)):
            yield c, t
            for d in sorted(d for d, (_, up) in ups.items() if up == (c, t)):
                yield from walk(d)

    order = {x: [m for c in sorted(thread) if thread[c] == x and c not in ups for m in walk(c)] for x in set(thread.values())}
    return [(*o, thread.get(o[0])) for o in out], order


def test_op4(spark):
    r = random.Random(5)
    said = [" ".join(r.choice(["alpha", "Beta", "gamma,", "delta.", "é"]) for _ in range(r.choice([1, 3, 9]))) for _ in range(40)]
    rows = []
    for c in range(25):
        for t in range(r.randrange(1, 7)):
            lines = []
            for _ in range(r.randrange(0, 5)):
                lines.append(r.choice(["", "", "> ", ">", "> > ", ">>", " >\t"]) + r.choice([*said, "", "  "]))
            rows.append((c, t, r.choice(["user", "assistant"]), r.choice(["\n", "\n", "\r\n"]).join(lines)))
    rows += [(None, 1, "user", "> alpha"), (3, None, "user", "alpha"), (4, 9, None, None), rows[0], (5, 3, "user", rows[1][3]), (90, 0, "user", "one\ntwo\n\nthree"), (91, 0, "user", "> ONE\n>  two\nnew"), (91, 1, "user", "> three\n>> gone\nok"), (91, 2, "user", "> New")]
    df = spark.createDataFrame([(*x, "b") for x in rows], "conv_id long, turn long, role string, text string, body string").repartition(3)
    got = quotes.link(df, Scratch(spark)).collect()
    want, order = brute(rows)
    key = lambda x: tuple((v is not None, v if v is not None else 0) if not isinstance(v, str) else v for v in x)
    have = sorted(((g.conv, g.turn, g.role or "", g.body, g.reply_conv, g.reply_turn, g.n_quotes, g.n_linked, g.thread_id) for g in got), key=key)
    assert have == sorted(((c, t, role or "", *rest) for c, t, role, *rest in want), key=key)
    assert {(g.reply_conv, g.reply_turn) for g in got if g.conv == 91} == {(90, 0), (91, 0)}
    threads = {}
    for g in got:
        if g.thread_id is not None:
            threads.setdefault(g.thread_id, []).append(g)
    for some in threads.values():
        some.sort(key=lambda g: g.position)
        assert [g.position for g in some] == list(range(len(some)))
        assert list(dict.fromkeys((g.conv, g.turn) for g in some)) == order[some[0].thread_id]
    assert quotes.link(df.limit(0), Scratch(spark)).count() == 0


def test_threads_and_partial_quotes(spark):
    long = "\n".join(f"line {i}" for i in range(11))
    rows = [
        (1, 0, "u", "first one"), (1, 1, "u", "second one"), (2, 0, "u", "other talk\n\nof three\n\nparagraphs"),
        (4, 0, "u", "> second one\nI see\n> other talk\n>\n> of  three\nok"),  # quotes two conversations
        (5, 0, "u", ">> nothing known\nx"), (6, 0, "u", long), (7, 0, "u", "\n".join(f"> LINE {i}" for i in range(2, 9)) + "\nsure"),
        (8, 0, "u", "> sure\nfollow up"), (9, 0, "u", "> line 3\n> line 5\nno"), (3, 0, "u", "> first one\nearly reply"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = {(r.conv, r.turn): r for r in quotes.link(df, Scratch(spark)).collect()}
    assert {got[k].thread_id for k in ((1, 0), (2, 0), (3, 0), (4, 0))} == {1} and got[4, 0].n_linked == 2
    assert [k for k, r in sorted(got.items(), key=lambda x: x[1].position) if r.thread_id == 1] == [(1, 0), (3, 0), (1, 1), (4, 0), (2, 0)]
    assert [k for k, r in sorted(got.items(), key=lambda x: x[1].position) if r.thread_id == 6] == [(6, 0), (7, 0), (8, 0)]
    assert got[5, 0].n_linked == 0 and got[9, 0].n_linked == 0 and got[9, 0].thread_id == 9
