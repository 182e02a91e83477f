import collections
import hashlib
import os
import re

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from dossier.llm import mixing
from dossier.llm.common import row_hash
from tests.llm.data import documents, empty
from tests.llm.test_dedup_and_bpe import slow_components, slow_fingerprint
from tests.llm.test_native import base_spans

DATA = "/root/testdata/sf0.001"


def slow_redaction(text):
    if text is None:
        return None
    out, end = [], 0
    for kind, a, b in (s.split(":") for s in base_spans(text)):
        a, b = int(a), int(b)
        if a >= end:
            out += [text[end:a], f"[{kind.upper()}]"]
        end = max(end, b)
    return "".join(out) + text[end:]


def slow_pipeline(spark, docs):
    """The rows of run(), by plain loops but for the mix, which has a test of its own."""
    rows = [r for r in docs.collect() if re.search(r"[^\W\d_]", r.text or "")]
    component = {d: c for d, c in slow_components([(r.doc_id, slow_fingerprint(r.text)) for r in rows])}
    rows = [r for r in rows if component[r.doc_id] == r.doc_id]
    rows = [(r.doc_id, text, r.lang, r.source, None if text is None else len(text)) for r in rows for text in [slow_redaction(r.text)]]
    clean = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    copies = {r.doc_id: r.copies for r in mixing.mix(clean, row_key=row_hash(clean)).collect()}
    library, out = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), collections.Counter()
    for doc_id, text, *_ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        out[doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()] += copies[doc_id]
    return +out


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_run_matches_plain_loops(spark):
    got = collections.Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, DATA).collect())
    assert got == slow_pipeline(spark, spark.read.parquet(f"{DATA}/documents.parquet"))


def test_stages_keep_the_columns_of_documents(spark):
    docs = documents(spark, [(100 + i, f"The house number {i} is green and the water is {i} deep.", "en", "a") for i in range(20)])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "pii", "mixing", "bpe"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "unused")
        assert out.columns == docs.columns and out.count() > 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, "unused")
    assert last.count() == docs.count() and "ids" in last.columns


def test_stages_on_an_empty_table(spark):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty(spark), "unused").count() == 0
