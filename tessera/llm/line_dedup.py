"""Line dedup by pairwise alignment.

A block is a run of equal lines; blank lines neither break it nor count.  Lines that only one document
has are in no block and go first; their number of documents makes the others rare or common.  From
each line on, the shortest run of the words asked for is a window, and so is the shortest run that
ends with it: every block that two documents share is made of windows that both have.  A window is
filed under its rarest line, and each document that has it is paired with the first one, so a passage in
n documents makes n - 1 pairs and no shared block is missed, whichever documents share it.

Each pair is aligned by patience diff, and what the later document has in aligned blocks goes.  One
alignment keeps the order, so it misses blocks that moved or repeat: where a shared window is left,
the later document from there on is aligned again with the earlier one from where that has the window, until no
window is left.  Nothing goes that no alignment holds.  The first document of all keeps every line.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import Scratch, give_back


def line_hashes(text: str) -> tuple[list[int], list[int]]:
    """Hash and number of words of each line, white space folded; 0 and 0 for a blank one."""
    hashes, counts = [], []
    for line in text.split("\n"):
        words = line.split()
        hashes.append((xxhash.xxh64_intdigest(" ".join(words).encode(), 42) or 1) - (1 << 63) if words else 0)
        counts.append(len(words))
    return hashes, counts


def _filled(hashes: list[int], counts: list[int]) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Places of the lines with words, their hashes, and words up to each line's end, from 0."""
    at = [i for i, n in enumerate(counts) if n]
    return at, np.array([hashes[i] for i in at], np.int64), _through([counts[i] for i in at])


def _through(counts: list[int]) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])


def windows(words: np.ndarray, min_words: int) -> list[tuple[int, int]]:
    """Windows (start, end) over the lines with words: from each line the shortest with
    ``min_words``, and to each line the shortest with as many."""
    n = len(words) - 1
    ends = np.searchsorted(words, words[:-1] + min_words)
    starts = np.searchsorted(words, words[1:] - min_words, side="right") - 1
    out = {(i, int(e)) for i, e in enumerate(ends) if e <= n}
    return sorted(out | {(int(b), j + 1) for j, b in enumerate(starts) if b >= 0})


def anchors(places: list[int], lines: list[int], counts: list[int], often: list[int], min_words: int) -> list[tuple[int, int]]:
    """(rarest line, hash) of each distinct window in some of a document's filled lines: their
    places among all of them in order, hashes, words, and documents that have each."""
    out: set[tuple[int, int]] = set()
    start = 0
    for end in range(1, len(places) + 1):
        if end == len(places) or places[end] != places[end - 1] + 1:
            run = lines[start:end]
            data, rarity = np.array(run, "<i8").tobytes(), list(zip(often[start:end], run))
            for a, b in windows(_through(counts[start:end]), min_words):
                out.add((min(rarity[a:b])[1], xxhash.xxh64_intdigest(data[8 * a : 8 * b], 7) - (1 << 63)))
            start = end
    return list(out)


def _longest_rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence with rising second members, by patience piles."""
    tops: list[int] = []
    piles: list[int] = []
    back: list[int] = []
    for i, (_, j) in enumerate(pairs):
        at = bisect_left(tops, j)
        back.append(piles[at - 1] if at else -1)
        if at == len(tops):
            tops.append(j)
            piles.append(i)
        else:
            tops[at], piles[at] = j, i
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Matched positions (i, j), rising in both: equal ends first, then lines that are unique on
    both sides, then the same between those."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i0, i1, j0, j1 = todo.pop()
        while i0 < i1 and j0 < j1 and a[i0] == b[j0]:
            out.append((i0, j0))
            i0, j0 = i0 + 1, j0 + 1
        while i0 < i1 and j0 < j1 and a[i1 - 1] == b[j1 - 1]:
            i1, j1 = i1 - 1, j1 - 1
            out.append((i1, j1))
        if i0 == i1 or j0 == j1:
            continue
        place: dict[int, int] = {}
        for j in range(j0, j1):
            place[b[j]] = -1 if b[j] in place else j
        once: dict[int, int] = {}
        for i in range(i0, i1):
            if place.get(a[i], -1) >= 0:
                once[a[i]] = -1 if a[i] in once else i
        fixed = [(i, place[h]) for h, i in once.items() if i >= 0]
        fixed = _longest_rising(fixed)
        if fixed:
            ends = [(i0 - 1, j0 - 1), *fixed, (i1, j1)]
            out += fixed
            todo += [(p + 1, r, q + 1, s) for (p, q), (r, s) in zip(ends, ends[1:])]
    return sorted(out)


def _blocks(matched: list[tuple[int, int]], words: np.ndarray, min_words: int) -> Iterator[tuple[int, int]]:
    """Ranges of lines that an alignment holds without a gap on either side, with the words asked for."""
    start = 0
    for k in range(1, len(matched) + 1):
        if k == len(matched) or (matched[k][0], matched[k][1]) != (matched[k - 1][0] + 1, matched[k - 1][1] + 1):
            i, j = matched[start][0], matched[k - 1][0] + 1
            if words[j] - words[i] >= min_words:
                yield i, j
            start = k


def _equal_run(x: np.ndarray, y: np.ndarray) -> int:
    """How many elements from the start on are equal."""
    at, step, n = 0, 64, min(len(x), len(y))
    while at < n:
        same = x[at : min(at + step, n)] == y[at : min(at + step, n)]
        if not same.all():
            return at + int(same.argmin())
        at, step = at + len(same), 2 * step
    return n


def shared_blocks(later: list[int], counts: list[int], earlier: list[int], earlier_counts: list[int], min_words: int) -> list[tuple[int, int]]:
    """Line ranges of ``later`` in blocks of ``min_words`` words or more that ``earlier`` has too.

    Lines of no shared window can be in no block, and are set aside before the first alignment.
    While a shared window has lines left, the equal run from its place on in both documents is
    aligned, which takes moved and repeated blocks."""
    at, mine, words = _filled(later, counts)
    _, theirs, their_words = _filled(earlier, earlier_counts)
    data, other = mine.astype("<i8", copy=False).tobytes(), theirs.astype("<i8", copy=False).tobytes()
    there: dict[bytes, int] = {}
    for a, b in windows(their_words, min_words):
        there.setdefault(other[8 * a : 8 * b], a)
    shared = [(a, b, there[w]) for a, b in windows(words, min_words) if (w := data[8 * a : 8 * b]) in there]
    if not shared:
        return []
    lines, hit = mine.tolist(), [False] * len(mine)
    for a, b, _ in shared:
        hit[a:b] = [True] * (b - a)
    theirs_ = theirs.tolist()
    known = {lines[i] for i, h in enumerate(hit) if h}
    spans = list(_blocks(patience([x if h else None for x, h in zip(lines, hit)], [x if x in known else -1 for x in theirs_]), words, min_words))
    gone = np.zeros(len(lines), bool)
    for i, j in spans:
        gone[i:j] = True
    for a, b, c in shared:
        if not gone[a:b].all():
            size = _equal_run(mine[a:], theirs[c:])
            for i, j in _blocks(patience(lines[a : a + size], theirs_[c : c + size]), words[a : a + size + 1], min_words):
                spans.append((a + i, a + j))
                gone[a + i : a + j] = True
    out: list[tuple[int, int]] = []
    for i, j in sorted(spans):
        if out and i < out[-1][1]:  # a blank line between two blocks stays
            out[-1] = (out[-1][0], max(out[-1][1], j))
        else:
            out.append((i, j))
    return [(at[i], at[j - 1] + 1) for i, j in out]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.withColumns({"_id": F.col(id_col).cast("long"), "_h": F.xxhash64(F.coalesce(text_col, F.lit("")))})


def blocks_to_delete(docs: DataFrame, scratch: Scratch, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _h, spans array<struct<a,b>>): line ranges to delete from the documents that have
    any, by id and text hash."""

    def read(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            hashes, counts = [], []
            for t in b.column(2):
                h, c = line_hashes(t.as_py())
                hashes.append(h)
                counts.append(c)
            columns = [b.column(0), b.column(1), pa.array(hashes, pa.list_(pa.int64())), pa.array(counts, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["_id", "_h", "hashes", "counts"])
            give_back()

    def mark(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            rare, window, of = [], [], []
            for row, found in enumerate(b.column(2).to_pylist()):
                found.sort(key=lambda x: x["place"])
                for r, w in anchors(*([x[c] for x in found] for c in ("place", "line", "words", "often")), min_words):
                    of.append(row)
                    rare.append(r)
                    window.append(w)
            of = pa.array(of, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0).take(of), b.column(1).take(of), pa.array(rare, pa.int64()), pa.array(window, pa.int64())], names=["_id", "_h", "rare", "window"])

    named = _keyed(docs, id_col, text_col).where(F.col("_id").isNotNull() & F.col(text_col).isNotNull()).select("_id", "_h", text_col)
    lines = scratch.cut(named.mapInArrow(read, "_id long, _h long, hashes array<long>, counts array<int>"), "lines")
    filled = F.filter(F.zip_with("hashes", "counts", lambda h, n: F.struct(h.alias("line"), n.alias("words"))), lambda x: x["words"] > 0)
    flat = lines.select("_id", "_h", F.posexplode(filled).alias("place", "x")).select("_id", "_h", "place", "x.*")
    once = lines.select("_id", F.explode(F.array_distinct("hashes")).alias("line"))
    often = once.groupBy("line").agg(F.count("*").alias("often"), F.min("_id").alias("low"), F.max("_id").alias("high")).where("low < high").select("line", "often")
    common = flat.join(often.hint("merge"), "line").groupBy("_id", "_h").agg(F.collect_set(F.struct("place", "line", "words", "often")).alias("found"))  # a document's own lines at most
    at = scratch.cut(common.mapInArrow(mark, "_id long, _h long, rare long, window long"), "windows").select(F.struct("_id", "_h").alias("doc"), "rare", "window")
    firsts = at.groupBy("rare", "window").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first._id < last._id").drop("last")
    pairs = at.join(firsts, ["rare", "window"]).where("first._id < doc._id").select("doc._id", "doc._h", F.col("first._id").alias("e_id"), F.col("first._h").alias("e_h")).distinct()
    lines = lines.dropDuplicates(["_id", "_h"])
    earlier = lines.toDF("e_id", "e_h", "e_hashes", "e_counts")
    pairs = pairs.join(lines, ["_id", "_h"]).join(earlier, ["e_id", "e_h"])

    def align(batches: Iterator[pa.RecordBatch]):
        kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
        for b in batches:
            spans = [shared_blocks(*x, min_words) for x in zip(*(b.column(i).to_pylist() for i in (2, 3, 4, 5)))]
            spans = pa.array([[{"a": p, "b": q} for p, q in s] for s in spans], kind)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), spans], names=["_id", "_h", "spans"])

    found = pairs.select("_id", "_h", "hashes", "counts", "e_hashes", "e_counts").mapInArrow(align, "_id long, _h long, spans array<struct<a:int,b:int>>")
    found = found.select("_id", "_h", F.explode("spans").alias("s")).distinct()
    return found.groupBy("_id", "_h").agg(F.collect_list("s").alias("spans"))  # a document's own lines at most


def line_dedup(docs: DataFrame, scratch: Scratch, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs``, ``text`` without the deleted lines, and n_lines, n_removed.

    A line goes if it lies in a run of lines with ``min_words`` words that an earlier document has
    too, whichever that is.  Documents are ordered by id; the later one loses the block.  Rows with a null id or text stay
    as they are, and count as no one's earlier document.  Rows of one id are not compared with
    each other.  A text none of whose lines is left becomes empty.
    """
    spans = scratch.cut(blocks_to_delete(docs, scratch, min_words, id_col, text_col), "spans")
    lines = F.split(F.col(text_col), "\n")
    rows = _keyed(docs, id_col, text_col).join(spans.hint("merge"), ["_id", "_h"], "left")

    def kept(line: Column, i: Column) -> Column:
        return ~F.exists("spans", lambda s: (i >= s["a"]) & (i < s["b"]))

    text = F.when(F.col("spans").isNull(), F.col(text_col)).otherwise(F.array_join(F.filter(lines, kept), "\n"))
    n = F.coalesce(F.regexp_count(text_col, F.lit("\n")) + 1, F.lit(0))
    left = F.when(F.col("spans").isNull(), F.col("n_lines")).otherwise(F.size(F.filter(lines, kept)))
    out = rows.withColumn("n_lines", n).withColumn("n_removed", F.col("n_lines") - left).withColumn("_kept", text)
    return out.select(*(F.col("_kept").alias(c) if c == text_col else F.col(c) for c in docs.columns if c not in ("n_lines", "n_removed")), "n_lines", "n_removed")
