import random
import time

from tessera.llm import url_rules


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    n = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
    path = rest[n:]
    return rest[:n].translate(url_rules._LOWER), path[: min([path.index(c) for c in "?#" if c in path] or [len(path)])]


def brute(url, rules, default="allow"):
    host, path = split(url)
    fits = [(len(h) + len(p), len(h), v == "block", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *max(fits)[3:]) if fits else (host, path, None, default)


def test_op10_nested_paths(spark, monkeypatch):
    r = random.Random(1)
    host = lambda: ".".join(r.choice(["a", "b", "c", "a-b"]) for _ in range(r.randrange(1, 4)))
    path = lambda: "/" + "/".join(r.choice(["", "x", "xx", "xy", "é"]) for _ in range(r.randrange(0, 4)))
    rules = [(r.choice(["allow", "block"]), host(), r.choice(["", path(), path(), path()])) for _ in range(300)]
    urls = [f"http://{host().upper() if r.random() < 0.2 else host()}{r.choice(['', path(), path() + '?q=/x', path() + '#/x'])}" for _ in range(500)]
    urls += [None, "", "no scheme", "://", "x://a", "http://a?b/x", urls[0], urls[0]]
    df = spark.createDataFrame([(i, u, "k", "r") for i, u in enumerate(urls)], "page_id long, url string, key string, rule string").repartition(3)
    for at_once in (100_000, 37):
        monkeypatch.setattr(url_rules, "RULES_AT_ONCE", at_once)
        got = {x.page_id: (x.host, x.path, x.rule, x.verdict) for x in url_rules.judge(df, rules).collect()}
        assert got == {i: brute(u, rules) for i, u in enumerate(urls)}
    assert url_rules.judge(df.limit(0), rules).count() == 0 and url_rules.judge(df, []).where("rule is null and verdict = 'allow'").count() == len(urls)


def test_any_character_in_a_host(spark):
    """Labels with U+0000 and U+0001, and empty ones, are no borders between labels."""
    r = random.Random(3)
    label = lambda: "".join(r.choice(["\x00", "\x01", "\x02", "a", "é"]) for _ in range(r.randrange(0, 4)))
    host = lambda: ".".join(label() for _ in range(r.randrange(1, 4)))
    rules = [("allow", "org", "/"), ("block", "example.org", "/es/"), *((r.choice(["allow", "block"]), host(), "/") for _ in range(150))]
    urls = ["http://example\x00sub.org/es/x", "http://org\x00example/es/", "http://example.org\x00/es/", *(f"x://{host()}/" for _ in range(600))]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(3)
    got = {x.page_id: (x.host, x.path, x.rule, x.verdict) for x in url_rules.judge(df, rules).collect()}
    assert got == {i: brute(u, rules) for i, u in enumerate(urls)}
    assert got[0][2:] == ("org/", "allow") and got[1][2:] == (None, "allow")


def test_many_paths_of_a_host():
    """A URL's time does not grow with the number of its host's path rules."""
    r = random.Random(2)
    urls = [f"/p{r.randrange(10**6)}/x" for _ in range(3000)]

    def run(n):
        host = url_rules.HostRules([(f"/p{i}/", f"h/p{i}/", "block", i) for i in range(n)])
        start = time.perf_counter()
        for u in urls:
            host.best(u)
        return time.perf_counter() - start

    run(1000)
    assert run(100_000) < 10 * max(run(1000), 1e-3)
