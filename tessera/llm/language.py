"""Language identification by Bayesian evidence fusion.

Evidence on each document: the likelihood of its byte trigrams under each language, the language
its markup declares, and a prior from its host.  Besides the languages of the model there is one
alternative, that the text is in none of them, under which all trigrams are equally likely.
Priors come from one grouped aggregation of the text-only decisions over all documents, smoothed
level by level: host towards domain, domain towards address suffix, suffix towards all; a
document's own decision is taken out of every level.  The reliability of declarations is learned
the same way, by counting.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.shared import Scratch, give_back

#: Labelled rows of each language that the trigram model is fitted on at most.  It holds every
#: labelled language, at 256 kB each.
SAMPLE_ROWS = 500
#: Trigram buckets; weight of one trigram, since neighbours overlap; pseudo-counts of a level.
BUCKETS, WEIGHT, PSEUDO = 1 << 16, 0.3, 20.0
#: Bytes of one text scored at a time.
CHUNK = 1 << 18
#: A document is rejected below this posterior, if no language of the model is likelier than none,
#: or without any letter.
LEAST = 0.5
#: Prior weight of "none of these" beside the counted decisions, where each language has 1.
NONE_WEIGHT = 0.1
#: ISO 639-2 codes whose bibliographic form differs from the terminological one.
BIBLIOGRAPHIC = {
    "alb": "sq", "arm": "hy", "baq": "eu", "bur": "my", "chi": "zh", "cze": "cs", "dut": "nl", "fre": "fr", "geo": "ka", "ger": "de",
    "gre": "el", "ice": "is", "mac": "mk", "mao": "mi", "may": "ms", "per": "fa", "rum": "ro", "slo": "sk", "tib": "bo", "wel": "cy",
}


@dataclass(frozen=True)
class TrigramModel:
    languages: list[str]
    scores: np.ndarray  # BUCKETS x languages, log probabilities
    last: dict[str, int]  # largest hash of id and text in the sample, by language


def _buckets(data: bytes) -> np.ndarray:
    """Bucket of each byte trigram without a digit; numbers and keys are in no language."""
    b = np.frombuffer(data.lower(), np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.uint32)
    digit = (b >= 48) & (b <= 57)
    found = ((b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA77)) ^ (b[2:] * np.uint32(0xC2B2AE3D))) >> np.uint32(16)
    return found[~(digit[:-2] | digit[1:-1] | digit[2:])] if digit.any() else found


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> TrigramModel:
    """From SAMPLE_ROWS labelled rows of each language at most, those of the lowest hashes of id and
    text; whole texts.  Rows with a null text or label don't count; without any labelled row the
    model has no languages."""
    good = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    good = good.select(F.lower(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("h"))
    order = Window.partitionBy("lang").orderBy("h")  # a partition passes on SAMPLE_ROWS of a language at most
    ranked = good.select("lang", "h").withColumn("n", F.row_number().over(order)).where(F.col("n") <= SAMPLE_ROWS)
    last = {r[0]: r[1] for r in ranked.groupBy("lang").agg(F.max("h")).collect()}  # one row a language
    if not last:
        return TrigramModel([], np.zeros((BUCKETS, 0), np.float32), {})
    limits = labelled.sparkSession.createDataFrame(list(last.items()), "lang string, last long")

    def count(batches: Iterator[pa.RecordBatch]):
        by: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
                data = text.as_py().encode()
                for at in range(0, len(data), CHUNK):
                    have = by.setdefault(lang, np.zeros(BUCKETS, np.int64))
                    have += np.bincount(_buckets(data[at : at + CHUNK + 2]), minlength=BUCKETS)
        for lang, have in by.items():
            at = np.flatnonzero(have)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(have[at], pa.int64())], names=["lang", "bucket", "n"])

    found: dict[str, np.ndarray] = {}
    counts = good.join(F.broadcast(limits), "lang").where("h <= last").select("lang", "text").mapInArrow(count, "lang string, bucket int, n long")
    counts = counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))  # BUCKETS rows a language at most
    for lang, bucket, n in counts.collect():
        found.setdefault(lang, np.zeros(BUCKETS, np.int64))[bucket] = n
    kept = sorted(last)
    table = np.stack([found.get(x, np.zeros(BUCKETS, np.int64)) for x in kept], axis=1) + 0.1
    return TrigramModel(kept, np.log(table / table.sum(axis=0)).astype(np.float32), last)


def score(rows: DataFrame, model: TrigramModel, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns, ``evidence`` array<double> of weighted log-likelihoods (all 0 without
    three bytes of text), that of none of the languages last, ``best`` index of the largest, and
    ``letters``: whether there is any."""
    even = -np.log(BUCKETS)

    def run(batches: Iterator[pa.RecordBatch]):
        k = len(model.languages)
        for b in batches:
            evidence, best, letters = [], [], []
            for t in b.column(len(keep)):
                text = t.as_py() or ""
                data, total = text.encode(), np.zeros(k + 1)
                for at in range(0, len(data), CHUNK):
                    buckets = _buckets(data[at : at + CHUNK + 2])
                    total[:k] += model.scores[buckets].sum(axis=0, dtype=np.float64)
                    total[k] += even * len(buckets)
                evidence.append((total * WEIGHT).tolist())
                best.append(int(total.argmax()))
                letters.append(any(c.isalpha() for c in text))
            columns = [*(b.column(i) for i in range(len(keep))), pa.array(evidence, pa.list_(pa.float64())), pa.array(best, pa.int32()), pa.array(letters, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "evidence", "best", "letters"])
            give_back()

    d = rows.select(*keep, F.col(text_col).alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema.fields[:-1])
    return d.mapInArrow(run, f"{kinds}, evidence array<double>, best int, letters boolean")


def visible_text(html: Column) -> Column:
    return F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1>|<[^>]*>|&#?\w+;", " ")


def declared_language(html: Column) -> Column:
    return F.lower(F.regexp_extract(html, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})(?![a-z])", 1))


def _language_index(declared: Column, languages: list[str]) -> Column:
    """Place of a declared language in the model: by its whole name, else by the first part of its
    tag, a code of three letters standing for that of two; -1 if the model hasn't got it."""
    order = {x: i for i, x in enumerate(languages)}
    locale = SparkSession.getActiveSession()._jvm.java.util.Locale
    long_codes = {locale.forLanguageTag(x).getISO3Language(): x for x in set(languages) & set(locale.getISOLanguages())}
    long_codes |= {k: v for k, v in BIBLIOGRAPHIC.items() if v in order}
    places = {**{k: order[v] for k, v in long_codes.items() if k}, **order}
    table = F.create_map(*(F.lit(v) for pair in places.items() for v in pair))
    whole = F.lower(F.coalesce(declared, F.lit("")))
    return F.coalesce(F.element_at(table, whole), F.element_at(table, F.regexp_extract(whole, r"^([a-z]{2,3})(?=$|[-_])", 1)), F.lit(-1))


def identify(rows: DataFrame, model: TrigramModel, scratch: Scratch, keep: list[str], text_col: str, host_col: str, declared_col: str) -> DataFrame:
    """``keep`` columns, lang, posterior, accepted for every row of ``rows``.

    A null or empty text, host or declaration is no evidence of its kind; what has none at all
    gets the corpus prior and is rejected, as is any text without a letter.  Ties go to the
    language that sorts first.  Rows that repeat count as often as they occur.  lang is the
    likeliest of the model's languages even where none of them is accepted.  A model without
    languages names and accepts none: lang and posterior are null.
    """
    k = len(model.languages)
    if not k:
        nothing = (F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("posterior"), F.lit(False).alias("accepted"))
        return rows.select(*keep, *nothing)
    host = F.lower(F.coalesce(F.col(host_col), F.lit("")))
    index = _language_index(F.col(declared_col), model.languages)
    named = rows.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), host.alias("host"), index.alias("declared"), F.col(text_col).alias("text"))
    scored = scratch.cut(score(named, model, [*(f"k{i}" for i in range(len(keep))), "host", "declared"]), "scored")

    # Hosts without dots have themselves as domain and suffix.
    counted = scratch.cut(scored.groupBy("host", "declared", "best").agg(F.count("*").alias("n")), "counts")

    def counts() -> Column:
        return F.array(*(F.sum(F.when(F.col("best") == i, F.col("n")).otherwise(0)).cast("double") for i in range(k + 1)))

    hosts = counted.groupBy("host").agg(counts().alias("of_host"))
    hosts = hosts.withColumn("domain", F.substring_index("host", ".", -2)).withColumn("suffix", F.substring_index("host", ".", -1))
    for level in ("domain", "suffix"):
        sums = F.array(*(F.sum(F.col("of_host")[i]) for i in range(k + 1)))
        hosts = hosts.join(hosts.groupBy(level).agg(sums.alias(f"of_{level}")), level)
    table = scratch.cut(hosts.select("host", "of_host", "of_domain", "of_suffix"), "hosts")
    totals = counted.groupBy().agg(counts().alias("n")).first()["n"]
    everywhere = [(x or 0.0) + (1.0 if i < k else NONE_WEIGHT) for i, x in enumerate(totals)]

    # Reliability of declarations, against text-only decisions: log p(declared | language).
    seen = np.full((k + 1, k), 0.0)
    for r in counted.where("declared >= 0").groupBy("declared", "best").agg(F.sum("n")).collect():
        seen[r[1], r[0]] = r[2]
    chance = np.log((seen + 1.0 + 8.0 * np.eye(k + 1, k)) / (seen + 1.0 + 8.0 * np.eye(k + 1, k)).sum(axis=1, keepdims=True))
    says = F.array(*(F.array(*(F.lit(float(chance[i, d])) for i in range(k + 1))) for d in range(k)))

    d = scored.join(table, "host").withColumn("says", F.when(F.col("declared") >= 0, F.element_at(says, F.col("declared") + 1)))
    # Corpus, suffix, domain, host: each level without the document's own decision.
    everywhere_ = F.array(*(F.lit(float(x)) for x in everywhere))

    def without_own(column: str) -> Column:
        return F.transform(F.col(column), lambda x, i: F.greatest(x - F.when(i == F.col("best"), 1.0).otherwise(0.0), F.lit(0.0)))

    d = d.withColumn("p", everywhere_).withColumn("p", F.transform("p", lambda x: x / F.lit(float(sum(everywhere)))))
    for level in ("of_suffix", "of_domain", "of_host"):
        d = d.withColumn("c", without_own(level)).withColumn("all", F.aggregate("c", F.lit(PSEUDO), lambda s, x: s + x))
        d = d.withColumn("p", F.zip_with("c", "p", lambda c, p: (c + PSEUDO * p) / F.col("all")))
    total = F.zip_with("evidence", "p", lambda e, p: e + F.log(p))
    d = d.withColumn("total", F.when(F.col("says").isNull(), total).otherwise(F.zip_with(total, "says", lambda t, x: t + x)))
    d = d.withColumn("most", F.array_max(F.slice("total", 1, k))).withColumn("top", F.array_max("total"))
    posterior = F.exp(F.col("most") - F.col("top")) / F.aggregate("total", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("top")))
    names = F.array(*(F.lit(x) for x in model.languages))
    lang = F.element_at(names, F.array_position("total", F.col("most")).cast("int"))
    d = d.withColumn("posterior", posterior)
    return d.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), lang.alias("lang"), "posterior", (F.col("letters") & (F.col("posterior") >= LEAST)).alias("accepted"))


def identify_pages(pages: DataFrame, model: TrigramModel, scratch: Scratch, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, host, declared, lang, posterior, accepted) for every page."""
    from tessera.llm.url_rules import host_of

    d = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("h"), declared_language(F.col(html_col)).alias("d"), visible_text(F.col(html_col)).alias("t"))
    out = identify(d, model, scratch, ["id", "h", "d"], "t", "h", "d")
    return out.withColumnsRenamed({"id": id_col, "h": "host", "d": "declared"})


def keep_identified(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", host_col: str = "source") -> DataFrame:
    """Rows of ``docs`` with an accepted language, ``lang_col`` set to it; all columns kept.

    The source stands for the host and the language column for the declaration, but not for rows
    that the model was fitted on, whose label would confirm itself.  Rows that repeat id and text
    are decided together.  Without a labelled text nothing can be told from anything: rows with a
    letter in their text stay as they are.
    """
    model = fit(docs, id_col, text_col, lang_col)
    if not model.languages:
        return docs.where(F.col(text_col).rlike(r"\p{L}"))
    last = F.create_map(*(F.lit(v) for pair in model.last.items() for v in pair))
    told = F.when(F.xxhash64(id_col, text_col) > F.element_at(last, F.lower(lang_col)), F.col(lang_col))
    keys = {"_i": F.coalesce(F.col(id_col).cast("long"), F.lit(0)), "_n": F.isnull(id_col), "_h": F.xxhash64(F.coalesce(text_col, F.lit(""))), "_d": F.coalesce(told, F.lit("")), "_s": F.coalesce(host_col, F.lit(""))}
    keyed = docs.withColumns(keys)
    found = identify(keyed, model, scratch, list(keys), text_col, "_s", "_d").where("accepted")
    found = scratch.cut(found.select(*keys, F.col("lang").alias("_lang")).dropDuplicates(list(keys)), "languages")
    out = keyed.join(found.hint("merge"), list(keys))
    return out.select(*(F.col("_lang").alias(c) if c == lang_col else F.col(c) for c in docs.columns))
