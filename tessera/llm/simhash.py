"""SimHash fingerprints and near-duplicates within a Hamming distance of two.

Fingerprints are embedded as vectors of bit counts of their segments.  The Manhattan distance
of two such vectors never exceeds the Hamming distance, so a range join on the integer grid of
the vectors, radius two, loses nothing.  Two vectors within two steps share a grid cell within
one step of both; each distinct vector visits the cells around it and meets its partners there,
and a cell has no more visitors than neighbours, so no group grows with the data.  What meets
nobody is done.  The rest is verified exactly on the finest grid, segments of one bit, where the
distance is the Hamming distance itself: two fingerprints are within two bits exactly if they
share a visited cell.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.components import connected
from tessera.llm.shared import Scratch, give_back

SEED = 42
#: Shares of bits in which sets of similarity 0.8 differ at most, by measurement: of sets of fewer
#: than 5 shingles, fewer than 16, more; and standard deviations that a pair may exceed it.
SHARES, DEVIATIONS = ((5, 0.19), (16, 0.165), (1 << 62, 0.1545)), 3.0
#: Bits of a band: unrelated documents rarely meet, even among 10^9 (some hundred a band and document).
BAND_BITS = 30
#: Bands after which the roots of compared mates are renewed, and rounds of mates by shingles.
MATES, SHINGLE_MATES = 5, 2
#: Documents of a cell up to which all pairs of different roots are compared.  Unrelated ones meet so few at a
#: time, in numbers that grow faster than the documents; their shingles need not be read.
FEW = 8
#: The same where only pairs leave a cell whose fingerprints are near enough: a document is compared with fewer than
#: this in a cell.
FEW_ALIKE = 32


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 of every run of ``words`` words, A-Z lower-cased, space-joined; the whole sequence if
    it is shorter; nothing for a text without words."""
    split = text.encode().lower().split()
    if not split:
        return np.zeros(0, np.uint64)
    joined = b" ".join(split)
    size = np.fromiter(map(len, split), np.int64, len(split)) + 1
    ends = np.cumsum(size) - 1
    n = max(1, len(split) - words + 1)
    starts, stops = (ends - size + 1)[:n].tolist(), ends[-n:].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops)), np.uint64, n)


def _mixed(h: np.ndarray, lane: int) -> np.ndarray:
    """Another independent 64-bit hash for each lane; lane 0 is the hash itself."""
    if not lane:
        return h
    z = h + np.uint64(0x9E3779B97F4A7C15 * lane & (1 << 64) - 1)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def fingerprint(text: str, words: int, lanes: int = 1, distinct: bool = False) -> tuple[list[int], int]:
    """Lanes, and the number of shingles.  A bit is 1 if it is set in over half the shingles'
    hashes; zero for a text without words.  If ``distinct``, each hash counts once, and where half
    of them have the bit that of the smallest hash decides, without which the fingerprints of few
    shingles would hold few ones and be close to each other."""
    hashes = shingle_hashes(text, words)
    if distinct:
        hashes = np.unique(hashes)
    out = []
    for lane in range(lanes):
        counts = np.zeros(64, np.int64)
        for at in range(0, len(hashes), 1 << 16):
            h = _mixed(hashes[at : at + (1 << 16)], lane).astype("<u8", copy=False)
            counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        ones = counts * 2
        if distinct and len(hashes):
            ones += np.unpackbits(_mixed(hashes[:1], lane).astype("<u8", copy=False).view(np.uint8), bitorder="little")
        out.append(int(np.packbits(ones > len(hashes), bitorder="little").view("<u8")[0]))
    return out, len(hashes)


def fingerprints(docs: DataFrame, words: int, lanes: int = 1, id_col: str = "doc_id", text_col: str = "text", distinct: bool = False) -> DataFrame:
    """(id, f0 .. f{lanes-1} long, n long: shingles) of every whole text; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            rows = [fingerprint(t.as_py() or "", words, lanes, distinct) for t in b.column(1)]
            lane = [pa.array([_signed(r[i]) for r, _ in rows], pa.int64()) for i in range(lanes)]
            yield pa.RecordBatch.from_arrays([b.column(0), *lane, pa.array([n for _, n in rows], pa.int64())], names=["id", *(f"f{i}" for i in range(lanes)), "n"])
            give_back()

    named = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return named.mapInArrow(run, "id long, " + "".join(f"f{i} long, " for i in range(lanes)) + "n long")


def segment_counts(fp: Column) -> Column:
    """Thirty-two counts of two bits each, one in each pair of bits."""
    odd = F.lit(0x5555555555555555)
    a, b = fp.bitwiseAND(odd), F.shiftrightunsigned(fp, 1).bitwiseAND(odd)
    return a.bitwiseXOR(b).bitwiseOR(F.shiftleft(a.bitwiseAND(b), 1))


def _around(counts: Column) -> Column:
    """A vector of segment counts and all within one step of it: 0 and 1, and 1 and 2, differ in
    the same bits of their pair either way."""
    steps = []
    for i in range(32):
        digit = F.shiftrightunsigned(counts, 2 * i).bitwiseAND(F.lit(3))
        steps.append(F.when(digit < 2, counts.bitwiseXOR(F.lit(_signed(1 << 2 * i)))))
        steps.append(F.when(digit > 0, counts.bitwiseXOR(F.lit(_signed(3 << 2 * i)))))
    return F.array_compact(F.array(counts, *steps))


def _around_bits(fp: Column, bits: int = 64) -> Column:
    return F.array(fp, *(fp.bitwiseXOR(F.lit(_signed(1 << i))) for i in range(bits)))


def close_pairs(distinct: DataFrame, scratch: Scratch) -> DataFrame:
    """Edges (a, b) that connect all fingerprints of ``distinct`` (column fp) within two bits."""
    placed = distinct.select("fp", segment_counts(F.col("fp")).alias("counts"))
    # Dealt anew, since each vector becomes 65 rows and adaptive execution only sees their small number.
    tasks = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    vectors = placed.groupBy("counts").agg(F.count("*").alias("n")).repartition(tasks, "counts")
    met = vectors.select("counts", F.explode(_around(F.col("counts"))).alias("cell"))
    met = met.groupBy("cell").agg(F.collect_list("counts").alias("here")).where(F.size("here") > 1)
    met = met.select(F.explode("here").alias("counts")).unionAll(vectors.where("n > 1").select("counts")).distinct()
    kept = scratch.cut(placed.join(met, "counts", "left_semi").select("fp"), "candidates")
    bits = kept.select("fp", F.explode(_around_bits(F.col("fp"))).alias("cell"))
    bits = bits.groupBy("cell").agg(F.min("fp").alias("a"), F.collect_list("fp").alias("here")).where(F.size("here") > 1)
    pairs = bits.select("a", F.explode("here").alias("b")).where("a <> b").distinct()
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)


def components(docs: DataFrame, scratch: Scratch, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id) of every row: 16 hexadecimal digits, and the smallest id
    reachable by links of two differing bits or fewer, itself included.

    Copies share a fingerprint and enter as one.  Texts without words have fingerprint zero.
    Rows with a null id get the smallest id of their component, null if it has none.
    """
    marks = scratch.cut(fingerprints(docs, words, 1, id_col, text_col).select("id", F.col("f0").alias("fp")), "marks")
    classes = scratch.cut(marks.groupBy("fp").agg(F.min("id").alias("first")), "classes")
    roots = connected(close_pairs(classes.select("fp"), scratch), scratch)
    rooted = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    label = rooted.join(least, "root").select("fp", "component_id")
    out = marks.join(label, "fp")
    return out.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# Wide fingerprints: near-duplicates by a similarity of shingle sets.


def expected_share(similarity: float) -> float:
    """Share of differing bits for two sets of equal size and this Jaccard similarity."""
    return math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi


def banding(similarity: float, recall: float) -> int:
    """Number of bands of BAND_BITS bits that a pair of exactly this similarity needs to meet in
    one of them with this probability.  It does not depend on the number of documents."""
    p = expected_share(similarity)
    meets = sum(math.comb(BAND_BITS, i) * p**i * (1 - p) ** (BAND_BITS - i) for i in range(3))
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - meets)))


def lanes_of(bands: int) -> int:
    """Lanes of 64 bits that hold all bands without sharing a bit."""
    return math.ceil(BAND_BITS * bands / 64)


def _alike(x: list[Column], y: list[Column], n: Column, m: Column, similarity: float) -> Column:
    """Whether sets of n and m shingles may have this similarity: the sizes allow it, and no more
    of these lanes' bits differ than SHARES and DEVIATIONS allow."""

    def most(share: float) -> int:
        width = 64 * len(x)
        return math.floor(share * width + DEVIATIONS * math.sqrt(share * (1 - share) * width))

    differ = reduce(Column.__add__, (F.bit_count(p.bitwiseXOR(q)) for p, q in zip(x, y)))
    small, large = F.least(n, m), F.greatest(n, m)
    return (small >= large * similarity - 1e-9) & (differ <= F.coalesce(*(F.when(small < n, most(share)) for n, share in SHARES)))


class _Verifier:
    """Accepts pairs of documents by the exact similarity of their sets of shingles."""

    def __init__(self, docs: DataFrame, classes: DataFrame, scratch: Scratch, words: int, similarity: float, lane: list[str]):
        self.docs, self.classes, self.scratch = docs, classes, scratch
        self.words, self.similarity, self.lane = words, similarity, lane

    def sets(self, ids: DataFrame) -> DataFrame:
        """(id, set array<long>): the distinct shingle hashes of these documents."""
        words = self.words

        def run(batches: Iterator[pa.RecordBatch]):
            for b in batches:
                sets = [np.unique(shingle_hashes(t.as_py() or "", words)).view(np.int64) for t in b.column(1)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["id", "set"])
                del sets
                give_back()

        return self.scratch.cut(self.docs.join(ids, "id", "left_semi").mapInArrow(run, "id long, set array<long>"), "sets")

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) of this Jaccard similarity or more; the fingerprints only spare the
        sets of pairs that are far apart."""
        scratch, lane = self.scratch, self.lane
        pairs = pairs.distinct()
        for end in ("a", "b"):
            pairs = pairs.join(self.classes.select(F.col("id").alias(end), F.col("n").alias(f"{end}_n"), *(F.col(c).alias(f"{end}_{c}") for c in lane)), end)
        a, b = ([F.col(f"{end}_{c}") for c in lane] for end in ("a", "b"))
        pairs = scratch.cut(pairs.where(_alike(a, b, F.col("a_n"), F.col("b_n"), self.similarity)).select("a", "b"), "close")

        sets = self.sets(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
        for end in ("a", "b"):
            pairs = pairs.join(sets.select(F.col("id").alias(end), F.col("set").alias(f"{end}_set")), end)
        both = F.size(F.array_intersect("a_set", "b_set"))
        pairs = pairs.select("a", "b", both.alias("both"), (F.size("a_set") + F.size("b_set") - both).alias("any"))
        out = scratch.cut(pairs.where(F.col("both") >= F.col("any") * self.similarity - 1e-9).select("a", "b").distinct(), "links")
        scratch.drop(sets)
        return out


def near_duplicates(docs: DataFrame, scratch: Scratch, words: int = 5, similarity: float = 0.8, recall: float = 0.97, lanes: int = 12, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, component_id) of every document in a group of near-duplicates, the smallest id of the
    group as component.  Ids that are null take no part; null and empty texts are copies of each
    other.  Rows that repeat an id are one document: what is similar to one of them is linked to it.

    Fingerprints have 64 * ``lanes`` bits, or as many as the bands take without sharing a bit.
    Sets of equal fingerprints are one; a set of too few shingles to be this similar to any other
    (three at 0.8) has no other partners.  Bands meet within two differing bits on the grid of
    one-bit segments.  A pair that meets is accepted if the true similarity of its sets of shingles
    is ``similarity`` or more.

    First each document is compared with one other of its band value, chosen by a hash, unless
    they are joined already: this joins large groups of near copies at a cost of their number.
    Then all cells are visited.  Two documents of different roots alone in a cell are compared.
    So are all pairs of different roots in cells of up to FEW_ALIKE.  Where more meet, as pages of one
    template do, all documents of such cells are joined by their rarest shingles, which loses no
    candidate and spares those that only share the template.  So no
    pair depends on the order of ids, on the size of its group or on the number of documents.

    What is lost: pairs that meet in no band, a share of 1 - ``recall`` of those exactly at the line and
    fewer above it, and pairs whose fingerprints differ by DEVIATIONS standard deviations more than
    their similarity lets expect.  Together under 5 in 100, measured in families of 100, 1,500 and
    10,000 pages.
    """
    bands = banding(similarity, recall)
    lanes = max(lanes, lanes_of(bands))
    named = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    marks = scratch.cut(fingerprints(named, words, lanes, "id", "text", True), "marks")
    lane = [f"f{i}" for i in range(lanes)]
    classes = scratch.cut(marks.groupBy(*lane, "n").agg(F.min("id").alias("id")), "classes")
    plan = [(k, _band(k)) for k in range(bands)]
    verifier = _Verifier(named, classes, scratch, words, similarity, lane)

    able = classes.where(F.col("n") + 1e-9 >= (F.col("n") + 1) * similarity)
    links, rooted = None, able.withColumn("root", F.col("id"))
    for step, some in enumerate((plan[:MATES], plan[MATES:], plan)):
        found = verifier.links(_mates(rooted, some, step))
        links = found if links is None else links.unionAll(found)
        roots = connected(links, scratch).withColumnRenamed("node", "id")
        rooted = scratch.cut(able.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")), "rooted")
        scratch.release()
    alone, met = [], []
    for at in range(0, bands, 4):  # four bands at a time bound the shuffle files on disk
        pairs, some = _meetings(rooted, plan[at : at + 4], scratch, FEW_ALIKE)
        alone.append(pairs)
        met.append(some)
        scratch.release()
    met = reduce(DataFrame.unionAll, met)
    alone.append(_few_pairs(met.where("cell is not null"), classes.select("id", "n", *lane), similarity))
    crowd = scratch.cut(met.where("cell is null").select("id").distinct(), "crowd")
    if not crowd.isEmpty():
        links, pairs = _crowd_links(crowd, able, rooted, links, verifier, scratch, similarity)
        alone.append(pairs)
    scratch.release()
    links = links.unionAll(verifier.links(reduce(DataFrame.unionAll, alone)))
    roots = connected(links, scratch).withColumnRenamed("node", "id")
    # Copies of a class hang on its first document.
    label = classes.join(roots, "id", "left").select(*lane, "n", F.coalesce("root", "id").alias("component_id"))
    return marks.join(label, [*lane, "n"]).select(F.col("id").alias(id_col), "component_id")


def _crowd_links(crowd: DataFrame, able: DataFrame, rooted: DataFrame, links: DataFrame, verifier: _Verifier, scratch: Scratch, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Links, with those found among ``crowd`` (id), and the pairs (a, b) of different roots by rare shingles that are left."""
    sets = verifier.sets(crowd)
    prefixes = scratch.cut(_prefixes(sets, similarity), "prefixes")
    scratch.release()
    for step in range(SHINGLE_MATES):  # large families of near copies are joined at a cost of their number
        links = links.unionAll(verifier.links(_shingle_mates(prefixes, rooted, step)))
        roots = connected(links, scratch).withColumnRenamed("node", "id")
        rooted = scratch.cut(able.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")), "rooted")
        scratch.release()
    return links, scratch.cut(_prefix_pairs(prefixes, rooted, similarity), "pairs")


def _band(k: int) -> Column:
    """Band k: the BAND_BITS consecutive bits after those of the bands before it."""
    at = k * BAND_BITS
    first, shift = at // 64, at % 64
    low = F.shiftrightunsigned(F.col(f"f{first}"), shift) if shift else F.col(f"f{first}")
    if shift + BAND_BITS > 64:
        low = low.bitwiseOR(F.shiftleft(F.col(f"f{first + 1}"), 64 - shift))
    return low.bitwiseAND(F.lit((1 << BAND_BITS) - 1))


def _values(bands: list[tuple[int, Column]], *more: Callable[[int], Column]) -> Column:
    """A row (band, value, p0, p1 ..) for each band."""
    return F.explode(F.array(*(F.struct(F.lit(k).alias("band"), value.alias("value"), *(m(k).alias(f"p{i}") for i, m in enumerate(more))) for k, value in bands))).alias("x")


def _mates(rooted: DataFrame, bands: list[tuple[int, Column]], step: int) -> DataFrame:
    """Pairs (a, b) of each document with one of its band value that has another root: the one
    whose hash is smallest, or largest if that has the same root."""
    rows = rooted.select("id", "root", F.xxhash64("id", F.lit(step)).alias("h"), _values(bands)).select("id", "root", "h", "x.*")
    ends = rows.groupBy("band", "value").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min("h").alias("least"), F.max("h").alias("most"))
    mixed = rows.join(ends.where("low < high"), ["band", "value"])
    chosen = mixed.where("h = least or h = most").groupBy("band", "value").agg(
        *(F.min(F.when(F.col("h") == F.col(end), F.col(c))).alias(f"{end}_{c}") for end in ("least", "most") for c in ("id", "root"))
    )
    mate = F.when(F.col("least_root") != F.col("root"), F.col("least_id")).when(F.col("most_root") != F.col("root"), F.col("most_id"))
    pairs = mixed.select("id", "root", "band", "value").join(chosen, ["band", "value"]).select(mate.alias("m"), "id").where("m is not null")
    return pairs.select(F.least("m", "id").alias("a"), F.greatest("m", "id").alias("b"))


def _meetings(rooted: DataFrame, bands: list[tuple[int, Column]], scratch: Scratch, few: int = FEW) -> tuple[DataFrame, DataFrame]:
    """Who meets whom in ``bands``: (a, b), pairs of documents with different roots that alone
    share a cell, and (band, cell, value, id, root), the documents of cells that more share, of different roots:
    a row for each cell of up to ``few`` documents, and one with band, cell and value NULL for all cells of more.

    A document visits the cells within one bit of its value, so two meet if their values are
    within two bits.  Two with the same value share all its cells and others two, of which the smallest counts
    (their own value, if they have the same): cells that are this to no pair go.  There are
    fewer pairs than visits, however many documents share a cell.
    """
    rows = rooted.select("id", "root", _values(bands)).select("id", "root", "x.*")
    values = rows.groupBy("band", "value").agg(F.count("*").alias("c"), F.min("root").alias("low"), F.max("root").alias("high"), F.min("id").alias("a"), F.max("id").alias("b"))
    visits = values.withColumn("cell", F.explode(_around_bits(F.col("value"), BAND_BITS))).repartition("band", "cell")
    cells = visits.groupBy("band", "cell").agg(F.sum("c").alias("c"), F.min("low").alias("low"), F.max("high").alias("high"), F.min("a").alias("a"), F.max("b").alias("b"))
    cells = scratch.cut(cells.where("c > 1 and low < high").select("band", "cell", "c", "a", "b"), "cells")
    # The values come again to their cells, rather than each crowded cell to all values around it,
    # so that the cost is one of documents.
    more = cells.where("c > 2").select("band", "cell", (F.col("c") <= few).alias("few")).hint("shuffle_hash")
    near = visits.select("band", "cell", "value", "c").join(more, ["band", "cell"])
    step, here = F.col("value").bitwiseXOR(F.col("cell")), Window.partitionBy("band", "cell")
    near = near.select("*", F.max("value").over(here).alias("top"), F.min(step).over(here).alias("least"), F.max(F.when(step == 0, F.col("c"))).over(here).alias("own"))
    near = near.where((F.col("own") > 1) | (F.col("top") > F.col("cell")) & (F.col("least") < F.col("top").bitwiseXOR(F.col("cell"))))
    near = near.select("band", "value", F.when(F.col("few"), F.col("cell")).alias("cell")).distinct()
    inside = F.col("cell").isNotNull()
    met = rows.join(near, ["band", "value"]).select(F.when(inside, F.col("band")).alias("band"), "cell", F.when(inside, F.col("value")).alias("value"), "id", "root").distinct()
    return cells.where("c = 2").select("a", "b").distinct(), scratch.cut(met, "met")


def _first_cell(x: Column, y: Column) -> Column:
    """The smallest cell that two values within two bits both visit, or x if they are one."""
    differ = x.bitwiseXOR(y)
    low = differ.bitwiseAND(-differ)
    either = F.least(x.bitwiseXOR(low), y.bitwiseXOR(low))
    return F.when(F.bit_count(differ) < 2, F.least(x, y)).otherwise(either)


def _few_pairs(met: DataFrame, classes: DataFrame | None = None, similarity: float = 0.0) -> DataFrame:
    """Pairs (a, b) of different roots in each cell of few documents, from the first cell in a band that both visit;
    with ``classes`` (id, n, f0 ..) those only that may have this similarity by all lanes, as they are accepted later."""
    lane = [c for c in classes.columns if c not in ("id", "n")] if classes is not None else []
    if classes is not None:
        met = met.join(classes.select(F.col("id").alias("doc"), "n", *lane), F.col("id") == F.col("doc"))
    cells = met.groupBy("band", "cell").agg(F.collect_list(F.struct("id", "root", "value", *(["n"] if lane else []), *lane)).alias("here"))

    def partners(x: Column) -> Column:
        def meets(y: Column) -> Column:
            out = (y["id"] > x["id"]) & (y["root"] != x["root"]) & (_first_cell(x["value"], y["value"]) == F.col("cell"))
            return out & _alike([x[c] for c in lane], [y[c] for c in lane], x["n"], y["n"], similarity) if lane else out

        return F.transform(F.filter("here", meets), lambda y: F.struct(x["id"].alias("a"), y["id"].alias("b")))

    return cells.select(F.explode(F.flatten(F.transform("here", partners))).alias("x")).select("x.a", "x.b").distinct()


def _rare_pairs(sets: DataFrame, rooted: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of different roots among ``sets`` (id, set) that may have this similarity.

    Two similar sets share one of their rarest shingles: of n in one order for all, rare ones first,
    the larger set has it among its first n - ceil(similarity * n) + 1, and the smaller one, which
    shares more of its own, among its first n - ceil(2 * similarity / (1 + similarity) * n) + 1.  So the
    short beginnings of the smaller sets meet the longer ones of the larger, no pair is lost, and
    pages that only share a template below the line do not meet at its shingles.  The first shingle
    that two share must leave enough behind it on both sides.  Documents joined already do not
    meet: a document is paired with the roots at a shingle first, then with those of their documents that may
    be similar, so there are no more rows than documents and candidates.
    """
    return _prefix_pairs(_prefixes(sets, similarity), rooted, similarity)


def _begins(share: float) -> Column:
    return F.col("at") <= F.col("n") - F.ceil(F.col("n") * share - 1e-9) + 1


def _prefixes(sets: DataFrame, similarity: float) -> DataFrame:
    """(id, n, at, s, c): of each set of n shingles the rarest ones that a similar one must share, their
    places and numbers of sets; what no other set has comes before all that is shared."""
    sized = sets.select("id", F.size("set").alias("n"), F.explode("set").alias("s"))
    often = sized.groupBy("s").agg(F.count("*").alias("c")).where("c > 1")
    own = Window.partitionBy("id")
    at = F.row_number().over(own.orderBy("c", "s")) + F.col("n") - F.count("*").over(own)
    return sized.join(often, "s").withColumn("at", at).where(_begins(similarity)).select("id", "n", "at", "s", "c")


def _shingle_mates(prefixes: DataFrame, rooted: DataFrame, step: int) -> DataFrame:
    """Pairs (a, b) of each document with one of another root, at the most common shingle of its
    prefix where there is one: as ``_mates``, one pair a document at most."""
    rows = prefixes.select("id", "s", "c").join(rooted.select("id", "root"), "id").withColumn("h", F.xxhash64("id", F.lit(step)))
    ends = rows.groupBy("s").agg(
        *(f(F.struct("h", "id", "root")).alias(k) for k, f in (("least", F.min), ("most", F.max))), F.min("root").alias("low"), F.max("root").alias("high")
    )
    mate = F.when(F.col("least.root") != F.col("root"), F.col("least.id")).when(F.col("most.root") != F.col("root"), F.col("most.id"))
    met = rows.join(ends.where("low < high"), "s").select("id", "c", "s", mate.alias("m")).where("m is not null")
    one = met.groupBy("id").agg(F.max(F.struct("c", "s", "m")).alias("x"))
    return one.select(F.least("id", "x.m").alias("a"), F.greatest("id", "x.m").alias("b")).distinct()


def _prefix_pairs(prefixes: DataFrame, rooted: DataFrame, similarity: float) -> DataFrame:
    """The pairs of ``_rare_pairs`` from prefixes."""
    large = prefixes.select("id", "n", "at", "s").join(rooted.select("id", "root"), "id")
    index = _begins(2 * similarity / (1 + similarity))
    meets = large.groupBy("s").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.max(index).alias("any"))
    large = large.join(meets.where("low < high and any").select("s"), "s", "left_semi")
    small = large.where(index)
    share = similarity / (1 + similarity)
    left = small.select("s", *(F.col(c).alias(f"l_{c}") for c in ("root", "id", "n", "at")))
    right = large.select("s", *(F.col(c).alias(f"r_{c}") for c in ("root", "id", "n", "at")))
    # First with the roots at a shingle: could any document of the root be similar?
    roots = right.groupBy("s", "r_root").agg(F.min("r_n").alias("least"), F.max("r_n").alias("most"), F.max(F.col("r_n") - F.col("r_at")).alias("room"))
    room = F.least(F.col("l_n") - F.col("l_at"), F.col("room")) + 1
    could = (F.col("l_root") != F.col("r_root")) & (F.col("l_n") <= F.col("most")) & (room >= (F.col("l_n") + F.greatest("l_n", "least")) * share - 1e-9)
    met = left.join(roots, "s").where(could).select("s", "l_id", "l_n", "l_at", "r_root")
    fit = F.least(F.col("l_n") - F.col("l_at"), F.col("r_n") - F.col("r_at")) + 1 >= (F.col("l_n") + F.col("r_n")) * share - 1e-9
    pairs = met.join(right, ["s", "r_root"]).where(fit & (F.struct("l_n", "l_id") < F.struct("r_n", "r_id")))
    return pairs.select(F.least("l_id", "r_id").alias("a"), F.greatest("l_id", "r_id").alias("b")).distinct()
