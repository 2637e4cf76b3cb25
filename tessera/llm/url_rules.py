"""URL rules by a sorted sweep over reversed-host keys.

Reversing a host's labels ("a.b.org" -> "org.b.a.") turns "this host and all its subdomains"
into a prefix, that is an interval of keys, and such intervals nest; so do the paths of one host's
rules.  URLs sorted by key and rules sorted by key are merged in one sweep that keeps a stack of the
hosts whose interval is open.  Each open host has its paths in order, each with the longest other
path around it: the last path not after the URL's, or one around it, is the longest that fits.  So
a URL costs a binary search for each open host, however many rules the host has.  URLs are sorted
inside their own scan task, so there is no exchange and a hot host costs no more than any other.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules carried to the tasks at once, which bounds what is broadcast; more go in further sweeps.
RULES_AT_ONCE = 100_000
_UPPER_AZ, _LOWER_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOWER = str.maketrans(_UPPER_AZ, _LOWER_AZ)


def _after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, url.substr(at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1)
    return F.coalesce(F.translate(host, _UPPER_AZ, _LOWER_AZ), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


#: U+0000 closes a label in a key; U+0000 and U+0001 inside a label are written as two characters.
_ESCAPED = (("\x01", "\x01\x02"), ("\x00", "\x01\x01"))


def host_key(host: Column) -> Column:
    """Labels in reverse order, each closed by a character that no label holds, so that hosts nest:
    one key begins another exactly if its host is the other's or a parent of it."""
    for plain, pair in _ESCAPED:
        host = F.replace(host, F.lit(plain), F.lit(pair))
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "\x00"), F.lit("\x00"))


def _key_of(host: str) -> str:
    """``host_key`` of a rule's host."""
    for plain, pair in _ESCAPED:
        host = host.replace(plain, pair)
    return "\x00".join(reversed(host.split("."))) + "\x00"


class HostRules:
    """The rules of one host: paths in order, what each rule says, and the path around each."""

    def __init__(self, rules: list[tuple[str, str, str, int]]):
        by_path: dict[str, tuple[str, str, int]] = {}
        for path, rule, verdict, rank in rules:
            if path not in by_path or rank > by_path[path][2]:
                by_path[path] = (rule, verdict, rank)
        self.paths = sorted(by_path)
        self.says = [by_path[p] for p in self.paths]
        self.around, open_ = [], []
        for i, p in enumerate(self.paths):
            while open_ and not p.startswith(self.paths[open_[-1]]):
                open_.pop()
            self.around.append(open_[-1] if open_ else -1)
            open_.append(i)

    def best(self, path: str) -> tuple[str, str, int] | None:
        """What the longest path that begins ``path`` says."""
        at = bisect_right(self.paths, path) - 1
        while at >= 0 and not path.startswith(self.paths[at]):
            at = self.around[at]
        return self.says[at] if at >= 0 else None


def _sweep(keys: list[str], paths: list[str], rules: list[tuple[str, HostRules]], open_: list, at: int):
    """Best rule (rule, verdict, rank) for each key in order.  ``open_`` is the stack; returns where the rules stand."""
    found = []
    for key, path in zip(keys, paths):
        while at < len(rules) and rules[at][0] <= key:
            while open_ and not rules[at][0].startswith(open_[-1][0]):
                open_.pop()
            open_.append(rules[at])
            at += 1
        while open_ and not key.startswith(open_[-1][0]):
            open_.pop()
        best = None
        for _, of_host in open_:
            says = of_host.best(path)
            if says is not None and (best is None or says[2] > best[2]):
                best = says
        found.append(best)
    return found, at


def judge(urls: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(id, host, path, rule, verdict) for every row.

    ``rules``: (verdict, host, path).  A rule fits its host and all subdomains if the url's path
    starts with the rule's; the longest host and path win, then the longer host, then ``block``.
    A null url, or one without ``://``, has an empty host and path and gets the default unless a
    rule has an empty host.  Rows with null or repeated ids stay.
    """
    key = urls.schema[id_col].dataType.simpleString()
    every = sorted({(h.translate(_LOWER), p, v) for v, h, p in rules})
    blocks = [every[i : i + RULES_AT_ONCE] for i in range(0, len(every), RULES_AT_ONCE)] or [[]]
    out = urls.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    out = out.withColumn("key", host_key(F.col("host"))).withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(None).cast("string"), "rank": F.lit(-1).cast("long")})
    for block in blocks:
        out = _sweep_frame(out, block, key)
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def _sweep_frame(urls: DataFrame, rules: list[tuple[str, str, str]], key: str) -> DataFrame:
    by_host: dict[str, list[tuple[str, str, str, int]]] = {}
    for host, path, verdict in rules:
        k = _key_of(host)
        rank = ((len(host) + len(path)) << 20 | len(host)) << 1 | (verdict == "block")
        by_host.setdefault(k, []).append((path, host + path, verdict, rank))
    in_order = [(k, HostRules(by_host[k])) for k in sorted(by_host)]
    shared = urls.sparkSession.sparkContext.broadcast(in_order)

    def run(batches: Iterator[pa.RecordBatch]):
        rules_, open_, at = shared.value, [], 0
        for b in batches:
            keys, paths = b.column(3).to_pylist(), b.column(2).to_pylist()
            found, at = _sweep(keys, paths, rules_, open_, at)
            had = b.column(6).to_pylist()
            old = list(zip(b.column(4).to_pylist(), b.column(5).to_pylist(), had))
            best = [f if f is not None and f[2] > o[2] else o for f, o in zip(found, old)]
            rule, verdict, rank = (list(x) for x in zip(*best)) if best else ([], [], [])
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in range(4)), pa.array(rule, pa.string()), pa.array(verdict, pa.string()), pa.array(rank, pa.int64())],
                names=["id", "host", "path", "key", "rule", "verdict", "rank"],
            )

    schema = f"id {key}, host string, path string, key string, rule string, verdict string, rank long"
    return urls.sortWithinPartitions("key").mapInArrow(run, schema)
