"""Registered queries of the training-data operators, one opN_<name> for each, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import audit, bpe, digests, language, lexical, line_dedup, mixture, packing, pfor, quotes, simhash, topk, url_rules
from tessera.llm.shared import Scratch, ship

#: (verdict, host, path) of the registered URL query.
URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe.codec_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(table(spark, sf_dir, "documents"), Scratch(spark))


def op3_vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integer_vectors(table(spark, sf_dir, "embeddings"))
    return topk.search(vectors, vectors.where("id % 50 = 0"), 5, Scratch(spark))


def op4_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.link(table(spark, sf_dir, "conversations"), Scratch(spark))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.line_dedup(docs, Scratch(spark))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = language.fit(table(spark, sf_dir, "documents"))
    return language.identify_pages(table(spark, sf_dir, "pages"), model, Scratch(spark))


def op7_pfor_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    shards = pfor.write_ids(docs, public_tokenizers.path("word_bpe_49k.json"), 2, Scratch(spark))
    return pfor.read_ids(shards)


def op8_exact_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests.edit_report(table(spark, sf_dir, "documents"), Scratch(spark))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), 1, Scratch(spark))


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), Scratch(spark), 10)


def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix_report(table(spark, sf_dir, "documents"), Scratch(spark))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), Scratch(spark))


QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_simhash": op2_simhash,
    "op3_vector_topk": op3_vector_topk,
    "op4_quotation_links": op4_quotation_links,
    "op5_line_dedup": op5_line_dedup,
    "op6_language_id": op6_language_id,
    "op7_pfor_files": op7_pfor_files,
    "op8_exact_digest": op8_exact_digest,
    "op9_packing": op9_packing,
    "op10_url_rules": op10_url_rules,
    "op11_lexical_search": op11_lexical_search,
    "op12_source_mix": op12_source_mix,
    "op13_filter_audit": op13_filter_audit,
}

ORACLE_SQL: dict[str, str] = {
    "op3_vector_topk": """
        WITH v AS (
          SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(floor(256 * x) AS BIGINT)) AS v FROM embeddings
          WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        p AS (
          SELECT q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
          FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM p)
        SELECT query_id, CAST(n AS INT) AS rank, vec_id, score FROM r WHERE n <= 5""",
    "op5_line_dedup": r"""
        WITH line AS (
          SELECT doc_id, i, ls[i] AS line,
            trim(regexp_replace(ls[i], '[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g')) AS f
          FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))),
        filled AS (
          SELECT doc_id, i, f, len(string_split(f, ' ')) AS n,
            row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k,
            sum(len(string_split(f, ' '))) OVER (PARTITION BY doc_id ORDER BY i) AS w
          FROM line WHERE f <> ''),
        whole AS (SELECT doc_id, list(f ORDER BY i) AS fs FROM filled GROUP BY doc_id),
        run AS (
          SELECT a.doc_id, a.i AS i, b.i AS j, md5(array_to_string(fs[a.k:b.k], chr(10))) AS key
          FROM filled a JOIN filled b ON a.doc_id = b.doc_id AND a.k <= b.k AND b.w - a.w + a.n >= 50
            AND (b.w - b.n - a.w + a.n < 50 OR b.w - a.w < 50)
          JOIN whole ON a.doc_id = whole.doc_id),
        gone AS (
          SELECT DISTINCT doc_id, unnest(range(i, j + 1)) AS i
          FROM run JOIN (SELECT key, min(doc_id) AS least FROM run GROUP BY key) USING (key) WHERE least < doc_id),
        kept AS (
          SELECT line.doc_id, string_agg(line, chr(10) ORDER BY line.i) AS text, count(*) AS n
          FROM line ANTI JOIN gone ON line.doc_id = gone.doc_id AND line.i = gone.i GROUP BY line.doc_id)
        SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(kept.text, '') END AS text,
          CAST(coalesce(len(string_split(d.text, chr(10))), 0) AS INT) AS n_lines,
          CAST(coalesce(len(string_split(d.text, chr(10))), 0) - coalesce(kept.n, 0) AS INT) AS n_removed
        FROM documents d LEFT JOIN kept ON d.doc_id = kept.doc_id""",
    "op10_url_rules": """
        WITH rest AS (
          SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS r FROM pages),
        split AS (
          SELECT page_id,
            coalesce(translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
            coalesce(regexp_extract(r, '^[^/?#]*([^?#]*)', 1), '') AS path FROM rest),
        rules(verdict, h, p) AS (VALUES
          ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
          ('allow', 'com', '/fr/'), ('block', 'com', '/de/'))
        SELECT s.page_id, s.host, s.path,
          arg_max(rules.h || rules.p, length(rules.h || rules.p)) AS rule,
          coalesce(arg_max(rules.verdict, length(rules.h || rules.p)), 'allow') AS verdict
        FROM split s LEFT JOIN rules
          ON (s.host = rules.h OR ends_with(s.host, '.' || rules.h)) AND starts_with(s.path, rules.p)
        GROUP BY s.page_id, s.host, s.path""",
    "op11_lexical_search": r"""
        WITH lower AS (
          SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
        word AS (
          SELECT r, doc_id, unnest(ts) AS term, len(ts) AS n FROM (
            SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM lower)),
        posting AS (SELECT r, doc_id, term, any_value(n) AS n, count(*) AS tf FROM word GROUP BY r, doc_id, term),
        stat AS (SELECT count(DISTINCT r) AS docs, CAST(sum(tf) AS BIGINT) AS len FROM posting),
        vocab AS (SELECT term, count(*) AS df FROM posting GROUP BY term),
        asked AS (
          SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark WHERE item_id IS NOT NULL),
        score AS (
          SELECT item_id, r, doc_id, CAST(sum(CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT)
            * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // len)))) AS BIGINT) AS score
          FROM asked JOIN vocab USING (term) JOIN posting USING (term), stat WHERE doc_id IS NOT NULL GROUP BY item_id, r, doc_id),
        best AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM score WHERE score > 0)
        SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM best WHERE rank <= 10""",
    "op12_source_mix": r"""
        WITH d AS (
          SELECT doc_id, coalesce('1' || source, '2') AS key, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
            md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS mix FROM documents),
        s AS (
          SELECT key, CAST(sum(size) AS BIGINT) AS total, [5, 2, 1][CAST((row_number() OVER (ORDER BY key) - 1) % 3 AS INT) + 1] AS weight FROM d GROUP BY key),
        stopped AS (
          SELECT sum(total) OVER w AS words, sum(weight) OVER w AS weights FROM s
          WINDOW w AS (ORDER BY CAST(total AS DOUBLE) / weight, key ROWS UNBOUNDED PRECEDING)
          UNION ALL SELECT 0, 0),
        level AS (
          SELECT max(CAST(150 * (SELECT sum(total) FROM s) - 200 * words AS DOUBLE) / CAST(100 * ((SELECT sum(weight) FROM s) - weights) AS DOUBLE)) AS level
          FROM stopped WHERE weights < (SELECT sum(weight) FROM s)),
        t AS (SELECT key, total, least(weight * level, CAST(2 * total AS DOUBLE)) AS target FROM s, level),
        run AS (SELECT d.*, sum(size) OVER (PARTITION BY key ORDER BY mix ROWS UNBOUNDED PRECEDING) - size AS since FROM d)
        SELECT doc_id, size, total AS source_size, target, CAST(
            greatest(0, least(size, CAST(floor(target) AS BIGINT) - since)) + greatest(0, least(size, CAST(floor(target) AS BIGINT) - total - since)) AS BIGINT) AS taken
        FROM run JOIN t USING (key)""",
    "op13_filter_audit": r"""
        WITH word AS (
          SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        mark AS (
          SELECT word.doc_id, part,
            [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t),
             regexp_matches(t, '[#$%&*|]'), coalesce(word.doc_id > min(word.doc_id) OVER (PARTITION BY t), false)] AS f,
            coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
          FROM word LEFT JOIN (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id) l ON word.doc_id = l.doc_id),
        letter(i, c) AS (VALUES (1, 'A'), (2, 'B'), (3, 'C'), (4, 'D'), (5, 'E')),
        ways AS (
          SELECT [a.i, b.i, c.i, d.i, e.i] AS o, a.c || b.c || c.c || d.c || e.c AS filter_order
          FROM letter a, letter b, letter c, letter d, letter e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
        step AS (SELECT filter_order, o, unnest(range(1, 6)) AS step FROM ways),
        kind AS (SELECT part, f, good, toxic, count(*) AS n FROM mark GROUP BY part, f, good, toxic),
        seen AS (
          SELECT part, filter_order, step, o[step] AS filter, f, good, toxic, n, f[o[step]] AS fails,
            len(list_filter(o[1:step - 1], lambda i: f[i])) > 0 AS gone, len(list_filter(f, lambda x: x)) AS many
          FROM kind, step),
        counted AS (
          SELECT part, filter_order, step, filter, CAST(coalesce(sum(n) FILTER (NOT gone AND NOT fails), 0) AS BIGINT) AS kept,
            CAST(coalesce(sum(n) FILTER (fails AND NOT gone), 0) AS BIGINT) AS removed, CAST(coalesce(sum(n) FILTER (fails AND gone), 0) AS BIGINT) AS redundant,
            CAST(coalesce(sum(n) FILTER (fails AND many = 1), 0) AS BIGINT) AS unique_fails,
            CAST(coalesce(sum(n) FILTER (fails AND NOT gone AND good), 0) AS BIGINT) AS good_lost,
            CAST(coalesce(sum(n) FILTER (fails AND NOT gone AND toxic), 0) AS BIGINT) AS toxic_lost
          FROM seen GROUP BY part, filter_order, step, filter)
        SELECT part, filter_order, CAST(step AS INT) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
          CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley FROM counted""",
}
