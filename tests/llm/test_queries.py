"""The registered queries on the smallest tables: columns, rows, and SQL where there is any."""

import os

import pytest

from kinvector.llm import registry

DATA = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_personal_data": {"doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"},
    "op2_best_fit_packing": {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"},
    "op3_language_id": {"doc_id", "held_out", "lang_pred", "score"},
    "op4_token_shards": {"doc_id", "start", "n_tokens", "ids_crc32"},
    "op5_mixing": {"doc_id", "source", "n_tokens", "epoch", "block"},
    "op6_near_dedup": {"doc_id", "n_shingles", "component_id", "kept"},
    "op7_near_vectors": {"vec_id", "n_links", "component_id", "kept"},
    "op8_line_dedup": {"doc_id", "n_lines", "n_dropped", "kept_sha256"},
    "op9_spotsigs": {"doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"},
    "op10_repeats": {"doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"},
    "op11_importance": {"doc_id", "n_features", "weight", "score", "rank"},
    "op12_hilbert_shards": {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"},
    "op13_filter_audit": {"part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"},
}
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, name):
    df = registry.queries()[name](spark, DATA)
    assert set(df.columns) >= COLUMNS[name]
    table = "embeddings" if name.startswith("op7") else "documents"
    n = spark.read.parquet(f"{DATA}/{table}.parquet").count()
    rows = df.collect()
    if name == "op13_filter_audit":
        assert len(rows) == 600 * len({r.part for r in rows}) and sum(r.kept + r.removed for r in rows if (r.filter_order, r.step) == ("ABCDE", 1)) == n
        return
    assert len({r[0] for r in rows}) == n if not name.startswith("op5") else rows
    assert name in ("op2_best_fit_packing", "op5_mixing") or len(rows) == n


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "labels"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    want = con.sql(registry.oracle_sql()[name])
    order = sorted(want.columns)
    got = registry.queries()[name](spark, DATA).select(*order).collect()
    assert len(got) > 100
    assert sorted(map(tuple, got), key=str) == sorted(con.sql(f"select {', '.join(order)} from ({registry.oracle_sql()[name]})").fetchall(), key=str)
