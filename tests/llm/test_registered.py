"""The registered queries on the smallest tables: columns, whole results, SQL where there is any."""

import duckdb
import pytest

import __spark_entry__
from tessera.llm import queries

COLUMNS = {
    "op1_byte_bpe": ("documents", ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]),
    "op2_simhash": ("documents", ["doc_id", "fingerprint", "component_id"]),
    "op3_vector_topk": (None, ["query_id", "rank", "vec_id", "score"]),
    "op4_quotation_links": ("conversations", ["conv", "turn", "role", "body", "thread_id", "position"]),
    "op5_line_dedup": ("documents", ["doc_id", "text", "n_lines", "n_removed"]),
    "op6_language_id": ("pages", ["page_id", "host", "declared", "lang", "posterior", "accepted"]),
    "op7_pfor_files": ("documents", ["doc_id", "start", "n_tokens", "ids_crc32"]),
    "op8_exact_digest": ("documents", ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]),
    "op9_packing": (None, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]),
    "op10_url_rules": ("pages", ["page_id", "host", "path", "rule", "verdict"]),
    "op11_lexical_search": (None, ["item_id", "rank", "doc_id", "score"]),
    "op12_source_mix": ("documents", ["doc_id", "size", "source_size", "target", "taken"]),
    "op13_filter_audit": (None, ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]),
}


def test_names():
    assert set(COLUMNS) == set(queries.QUERIES) and "pipeline" in __spark_entry__.queries()


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query(spark, sf_dir, name):
    table, columns = COLUMNS[name]
    df = queries.QUERIES[name](spark, sf_dir)
    assert df.columns[: len(columns)] == columns
    rows = df.collect()
    if table:
        assert len(rows) == spark.read.parquet(f"{sf_dir}/{table}.parquet").count()
    if name in queries.ORACLE_SQL:
        c = duckdb.connect()
        for t in ("documents", "embeddings", "pages", "benchmark", "labels"):
            c.execute(f"CREATE VIEW {t} AS FROM '{sf_dir}/{t}.parquet'")
        cursor = c.execute(queries.ORACLE_SQL[name])
        names = [d[0] for d in cursor.description]
        want = sorted(tuple(str(dict(zip(names, r))[k]) for k in df.columns) for r in cursor.fetchall())
        assert sorted(tuple(str(r[k]) for k in df.columns) for r in rows) == want


def test_wider_documents(spark, sf_dir, tmp_path):
    """Clashing extra columns, nulls and repeated rows in a whole table."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    d = d.unionByName(d.limit(3)).unionByName(spark.createDataFrame([(None, None, None, None, None)], d.schema))
    for c in ("id", "fp", "part", "ids", "n", "spans", "host", "place", "start"):
        d = d.selectExpr("*", f"'x' AS {c}")
    d.write.parquet(str(tmp_path / "documents.parquet"))
    for t in ("benchmark", "labels"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").selectExpr("*", "'x' AS id", "'x' AS term", "'x' AS part").write.parquet(str(tmp_path / f"{t}.parquet"))
    n = d.count()
    for name, (table, _) in COLUMNS.items():
        if table == "documents":
            assert queries.QUERIES[name](spark, str(tmp_path)).count() == n, name
    pieces = queries.QUERIES["op9_packing"](spark, str(tmp_path)).collect()
    assert sum(p.start == 0 for p in pieces) == n
    found = queries.QUERIES["op11_lexical_search"](spark, str(tmp_path)).collect()
    assert found and all(r.doc_id is not None and r.score > 0 for r in found)
    first = queries.QUERIES["op13_filter_audit"](spark, str(tmp_path)).where("filter_order = 'ABCDE' AND step = 1")
    assert first.agg({"kept": "sum"}).first()[0] + first.agg({"removed": "sum"}).first()[0] == n
