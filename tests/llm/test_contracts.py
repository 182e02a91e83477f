"""Columns, types and rows of each registered query on a table with every odd case: one row for each document."""

import pytest
from pyspark.sql import functions as F

from dossier.llm import queries
from tests.llm.data import documents, empty

FLAG, LONG, TEXT, REAL, INT = "boolean", "bigint", "string", "double", "int"
COLUMNS = {
    "op1_toxicity": {"doc_id": LONG, "held_out": FLAG, "score": REAL, "predicted": INT},
    "op2_bpe": {"doc_id": LONG, "n_tokens": LONG, "ids_sha256": TEXT, "decoded_sha256": TEXT},
    "op3_language_id": {"doc_id": LONG, "held_out": FLAG, "lang_pred": TEXT, "score": REAL},
    "op4_quality_classifier": {"doc_id": LONG, "held_out": FLAG, "score": REAL, "predicted": INT},
    "op6_quality_rules": {"doc_id": LONG, **dict.fromkeys(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"), LONG), "base_failed": FLAG, "kept": FLAG},
    "op7_pii": {"doc_id": LONG, **dict.fromkeys(("n_email", "n_ip", "n_card", "n_phone"), LONG), "base_sha256": TEXT, "spans": TEXT},
    "op9_near_dup": {"doc_id": LONG, "fingerprint": TEXT, "component_id": LONG},
    "op10_mixing": {"doc_id": LONG, "size": LONG, "source_size": LONG, "target": REAL, "taken": LONG},
    "op12_merkle": {"doc_id": LONG, **dict.fromkeys(("leaf", "subroot", "root", "proof_sha256", "folded_root"), TEXT), "verified": FLAG},
}
LIMITS = {
    "op1_toxicity": "score BETWEEN 0 AND 1 AND predicted = CAST(score >= 0.5 AS INT)",
    "op3_language_id": "score BETWEEN 0 AND 1",
    "op4_quality_classifier": "score BETWEEN 0 AND 1 AND predicted = CAST(score >= 0.3 AS INT)",
    "op6_quality_rules": "NOT (base_failed AND kept)",
    "op9_near_dup": "fingerprint RLIKE '^[0-9a-f]{16}$' AND (component_id IS NULL OR component_id <= doc_id)",
    "op10_mixing": "taken <= 2 * size",
}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    labels = spark.createDataFrame([(i, i % 2, i % 3 % 2) for i in range(9)] + [(1, 0, 0), (None, 1, 1), (2, None, None)], "doc_id bigint, quality int, toxic int")
    out = {}
    for name, docs in (("odd", documents(spark)), ("empty", empty(spark))):
        out[name] = str(tmp_path_factory.mktemp(name))
        docs.write.parquet(f"{out[name]}/documents.parquet")
        labels.write.parquet(f"{out[name]}/labels.parquet")
    return out


@pytest.mark.parametrize("name", COLUMNS)
def test_rows_and_types(spark, tables, name):
    got = queries.queries()[name](spark, tables["odd"])
    want = COLUMNS[name]
    assert dict(got.dtypes[: len(want)]) == want
    docs = spark.read.parquet(f"{tables['odd']}/documents.parquet")
    assert sorted(str(r.doc_id) for r in got.select("doc_id").collect()) == sorted(str(r.doc_id) for r in docs.collect())
    if name in LIMITS:
        assert got.filter(~F.coalesce(F.expr(LIMITS[name]), F.lit(False))).filter("doc_id is not null").count() == 0
    assert queries.queries()[name](spark, tables["empty"]).count() == 0
