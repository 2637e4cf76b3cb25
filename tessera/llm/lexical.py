"""Ranked lexical search by Fagin's threshold algorithm.

The index is two written tables: the forward index, a row for each document with its terms and
their occurrences, and the vocabulary with the number of documents of each term.  Documents stay
where they are: a task cuts its forward index into runs, sorts the postings of each of the queries'
terms by impact, and searches them for all queries.  A query's lists are read in turn from the top,
some entries of each at a time; every document met is scored in full by looking its terms up in the
forward index.  The threshold is the score that a document standing in all lists where they are read
now would have: when it is strictly below the query's k-th score, nothing unread can enter or tie.
The k best go on from run to run, so later runs stop early, and the tasks' results are merged.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import Scratch, give_back

#: A term: neither ASCII punctuation nor a control character nor white space of ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: In UTF-8 these are runs of ASCII letters and digits and of all bytes above ASCII.
_TERM_BYTES = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
#: Pairs of query and term sent out at once, documents searched together, and entries read of each
#: list at a time.
PAIRS_AT_ONCE, DOCS_AT_ONCE, DEPTH = 100_000, 20_000, 32


def terms_of(text: bytes) -> list[bytes]:
    """Terms of a text in order, A-Z lower-cased."""
    return _TERM_BYTES.findall(text.lower())


def forward_index(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, terms array<string>, tfs array<int>) of every text with a term, as written: its terms
    with repeats, its distinct terms and how often it has each."""

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            ids, n, terms, counts = [], [], [], []
            for row, raw in enumerate(b.column(1).cast(pa.binary())):
                found = terms_of(raw.as_py() or b"")
                if found:
                    tf = Counter(found)
                    ids.append(row)
                    n.append(len(found))
                    terms.append(list(tf))
                    counts.append(list(tf.values()))
            ends = pa.array(np.cumsum([0, *map(len, terms)]), pa.int32())
            flat = pa.array(chain.from_iterable(terms), pa.binary()).cast(pa.string())
            columns = [b.column(0).take(pa.array(ids, pa.int32())), pa.array(n, pa.int64()), pa.ListArray.from_arrays(ends, flat), pa.ListArray.from_arrays(ends, pa.array(chain.from_iterable(counts), pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "terms", "tfs"])
            give_back()

    named = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return scratch.cut(named.mapInArrow(run, "id long, n long, terms array<string>, tfs array<int>"), "forward")


def vocabulary(index: DataFrame, scratch: Scratch) -> DataFrame:
    """(term, df): documents that hold each term."""
    return scratch.cut(index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")), "vocabulary")


def query_terms(queries: DataFrame, words: DataFrame, n_docs: int, scratch: Scratch, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, term, weight) of the distinct terms of each item that some document holds and that weigh more
    than nothing; items that repeat an id have the terms of all."""
    text = F.translate(text_col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = F.explode(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)))
    asked = queries.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("item"), terms.alias("term")).distinct()
    weight = F.floor(1000 * F.log((2 * F.lit(n_docs) + 2) / (2 * F.col("df") + 1))).cast("long")
    return scratch.cut(asked.join(words, "term").select("item", "term", weight.alias("weight")).where("weight > 0"), "asked")


class Queries:
    """Some queries' terms, numbered, and each query's terms and weights."""

    def __init__(self, rows: list[tuple[int, str, int]]):
        terms = sorted({t for _, t, _ in rows})
        number = {t: i for i, t in enumerate(terms)}
        self.terms, self.weight = terms, np.zeros(len(terms), np.int64)
        by: dict[int, list[int]] = {}
        for item, term, weight in rows:
            by.setdefault(item, []).append(number[term])
            self.weight[number[term]] = weight
        self.items = [(item, np.sort(np.array(t))) for item, t in sorted(by.items())]


class Run:
    """Some documents' index for the queries' terms: postings by impact, and a forward index."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, ids: np.ndarray, n_terms: int):
        forward = np.lexsort((term, doc))
        self.ids, self.term, self.impact = ids, term[forward], impact[forward]
        self.start = np.searchsorted(doc[forward], np.arange(len(ids) + 1))
        order = np.lexsort((doc, -impact, term))
        self.docs, self.impacts = doc[order], impact[order]
        self.lists = np.searchsorted(term[order], np.arange(n_terms + 1))

    def scores(self, docs: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Full scores of ``docs`` by random access; ``wanted`` flags the query's terms."""
        begin, size = self.start[docs], self.start[docs + 1] - self.start[docs]
        ends = np.cumsum(size)
        at = np.arange(ends[-1]) + np.repeat(begin - (ends - size), size)
        worth = np.where(wanted[self.term[at]], self.impact[at], 0)
        return np.add.reduceat(worth, ends - size)

    def search(self, terms: np.ndarray, wanted: np.ndarray, best: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best (id, score) of ``best`` and this run's documents, by score and smaller id."""
        first, last = self.lists[terms], self.lists[terms + 1]
        held = last > first
        first, last = first[held], last[held]
        seen, at = np.zeros(len(self.ids), bool), first.copy()
        ids, scores = best
        while len(at):
            # The next entry of a list bounds what any document not met in it can have there.
            threshold = int(self.impacts[at].sum())
            if threshold <= 0 or (len(scores) >= k and threshold < scores[k - 1]):
                break
            upto = np.minimum(at + DEPTH, last)
            size = upto - at
            ends = np.cumsum(size)
            met = np.unique(self.docs[np.arange(ends[-1]) + np.repeat(at - (ends - size), size)])
            met = met[~seen[met]]
            if len(met):
                seen[met] = True
                ids, scores = np.concatenate([ids, self.ids[met]]), np.concatenate([scores, self.scores(met, wanted)])
                order = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[order], scores[order]
            left = upto < last
            at, last = upto[left], last[left]
        return ids, scores


def _runs(batches: Iterator[pa.RecordBatch], queries: Queries, n_docs: int, length: int) -> Iterator[Run]:
    """Runs of DOCS_AT_ONCE documents of a forward index with their impacts."""
    names = pa.array(queries.terms, pa.string())
    held: list[tuple[np.ndarray, ...]] = []
    base = 0

    def run() -> Run:
        doc, term, impact = (np.concatenate([h[i] for h in held]) for i in range(3))
        return Run(doc, term, impact, np.concatenate([h[3] for h in held]), len(queries.terms))

    for b in (x.slice(at, DOCS_AT_ONCE) for x in batches for at in range(0, x.num_rows, DOCS_AT_ONCE)):
        lists, tfs = b.column(2), b.column(3)
        doc = np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))
        number = pc.index_in(lists.flatten(), value_set=names)
        known = pc.is_valid(number).to_numpy(zero_copy_only=False)
        term, doc, tf = number.drop_null().to_numpy().astype(np.int64), doc[known], tfs.flatten().to_numpy()[known].astype(np.int64)
        m = 10 + 90 * b.column(1).to_numpy() * n_docs // length
        impact = queries.weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[doc]))
        held.append((doc + base, term, impact, b.column(0).to_numpy()))
        base += b.num_rows
        if base >= DOCS_AT_ONCE:
            yield run()
            held, base = [], 0
    if held:
        yield run()


def _search_block(index: DataFrame, asked: list[tuple[int, str, int]], n_docs: int, length: int, k: int, scratch: Scratch) -> DataFrame:
    """(item, doc, score): each task's k best documents of each item in a block, as written."""
    shared = index.sparkSession.sparkContext.broadcast(asked)  # PAIRS_AT_ONCE pairs, or one item

    def run(batches: Iterator[pa.RecordBatch]):
        queries = Queries(shared.value)
        none = np.zeros(0, np.int64)
        best = [(none, none)] * len(queries.items)
        wanted = np.zeros(len(queries.terms), bool)
        for part in _runs(batches, queries, n_docs, length):
            for i, (_, terms) in enumerate(queries.items):
                wanted[terms] = True
                best[i] = part.search(terms, wanted, best[i], k)
                wanted[terms] = False
        items = np.repeat([item for item, _ in queries.items], [len(ids) for ids, _ in best])
        columns = [items.astype(np.int64), *(np.concatenate([b[j] for b in best] or [none]) for j in (0, 1))]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["item", "doc", "score"])
        give_back()

    out = scratch.cut(index.mapInArrow(run, "item long, doc long, score long"), "found")
    shared.destroy()
    return out


def _blocks(asked: DataFrame, scratch: Scratch) -> tuple[DataFrame, list[int]]:
    """The items' terms with ``block``, so that a block has PAIRS_AT_ONCE rows or one item."""
    sizes = scratch.cut(asked.groupBy("item").agg(F.count("*").alias("pairs")).repartitionByRange("item").withColumn("range", F.spark_partition_id()), "items")
    totals = sizes.groupBy("range").agg(F.sum("pairs").alias("base"))  # a row for each task
    totals = totals.select("range", (F.sum("base").over(Window.orderBy("range")) - F.col("base")).alias("base"))
    through = F.sum("pairs").over(Window.partitionBy("range").orderBy("item")) + F.col("base")
    block = F.floor((through - 1) / PAIRS_AT_ONCE)
    of_item = sizes.join(totals, "range").select("item", block.alias("block"))
    out = scratch.cut(asked.join(of_item, "item"), "blocks")
    return out, sorted(r[0] for r in out.select("block").distinct().collect())


def search(docs: DataFrame, queries: DataFrame, scratch: Scratch, k: int = 10, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k documents with the highest score above 0, fewer
    if there are fewer; equal scores by the smaller id.

    Null and empty texts have no term and count nowhere.  Documents with a null id count in the
    statistics and are in no result; rows that repeat an id are documents of their own.  Items with a null id, without
    terms, or whose terms no document holds have no rows; items that repeat an id are one, with the
    terms of all.  Items go out in blocks, one after another.
    """
    spark = docs.sparkSession
    index = forward_index(docs, scratch, id_col, text_col)
    n_docs, length = index.agg(F.count("*"), F.sum("n")).first()
    asked, numbers = _blocks(query_terms(queries, vocabulary(index, scratch), n_docs, scratch, item_col, text_col), scratch)
    named = index.where("id is not null")
    found = []
    for number in numbers:
        rows = [tuple(r) for r in asked.where(F.col("block") == number).select("item", "term", "weight").collect()]
        found.append(_search_block(named, rows, n_docs, length, k, scratch))
    if not found:
        return spark.createDataFrame([], f"{item_col} long, rank int, {id_col} long, score long")
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), "doc")
    ranked = reduce(DataFrame.unionAll, found).where("score > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("item").alias(item_col), "rank", F.col("doc").alias(id_col), "score")
