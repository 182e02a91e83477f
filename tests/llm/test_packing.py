"""Power-of-two packing against the tokenizers library and plain loops."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from dossier.llm import packing, queries
from tests.llm.data import documents, empty


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(queries.word_vocabulary_path())
    t.no_padding()
    t.no_truncation()
    return t


def test_words_equal_the_library(tokenizer, monkeypatch):
    """Odd white space, marks, special tokens, capitals with odd lower case, long unspaced runs; a table that is forgotten."""
    rng = random.Random(1)
    odd = list(" \t\n\x0b\x1c\x1f\x85\xa0 　'aZéÉßΣςİ9٣½ .,!̸́\U0001f600퟿中|<>") + ["<|endoftext|>", "<|startoftext|>", " the ", "'re", "ing", "l'é", "aaaa", "ooo", "ÿŸĳ×", "l'", "ll", "'d"]
    texts = ["".join(rng.choices(odd, k=rng.randrange(40))) for _ in range(3000)] + ["", "x" * 5000, "ab1" * 900, " ", "Σίσυφος ΣΊΣΥΦΟΣ"]
    monkeypatch.setattr(packing, "TABLE_CHARS", 2000)
    words = packing.Words(queries.word_vocabulary_path())
    for k in range(0, len(texts), 500):
        part = texts[k : k + 500]
        ids, counts = words.encode(part)
        got = np.split(ids, np.cumsum(counts)[:-1])
        assert [g.tolist() for g in got] == [e.ids for e in tokenizer.encode_batch(part, add_special_tokens=False)]


def test_parts_equal_the_library(tokenizer, monkeypatch):
    """Contractions, runs of marks, digits and parts about as long as a key; a table that grows from four slots, over several blocks."""
    rng = random.Random(2)
    some = [*"'srevmltdSRL \t\n\x00aé×.!19<|>Ÿ", "<|endoftext|>", "слово ", " ’", *("x" * n for n in (7, 8, 9, 16, 17, 22, 23, 24, 25)), "é" * 12]
    texts = ["".join(rng.choices(some, k=rng.randrange(20))) for _ in range(3000)]
    monkeypatch.setattr(packing, "FIRST_BITS", 2)
    monkeypatch.setattr(packing, "BLOCK", 700)
    ids, counts = packing.Words(queries.word_vocabulary_path()).encode(texts)
    got = np.split(ids, np.cumsum(counts)[:-1])
    assert [g.tolist() for g in got] == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_parts_are_merged_once(monkeypatch):
    """Whatever stands beside a word, it is merged once, by all tasks of a worker; common texts do not need the library."""
    path, merged = queries.word_vocabulary_path(), []
    encode = packing.Merges.encode
    monkeypatch.setattr(packing.Merges, "encode", lambda self, pieces: merged.extend(pieces) or encode(self, pieces))
    monkeypatch.setattr(Tokenizer, "from_file", lambda _: pytest.fail("the library was opened"))
    words = packing.Words(path)
    for text in ("Erbleon erbleon. erbleon!! 17", "erbleon,### ERBLEON%%% erbleon's 71", "don't erbleon?é"):
        words.encode([text])
    assert len(merged) == len(set(merged)) and b"erbleon" in merged
    assert packing.words_of(path) is packing.words_of(path)


@pytest.mark.parametrize(("n", "want"), [(1, [1]), (7, [4, 2, 1]), (2048, [2048]), (2049, [2048, 1]), (6145, [2048, 2048, 2048, 1]), (4095, [2048, 1024, 512, 256, 128, 64, 32, 16, 8, 4, 2, 1])])
def test_lengths(n, want):
    assert packing.lengths(n) == want and sum(want) == n


def check(rows, docs, tokenizer):
    """Pieces cover each document's ids once; sequences are numbered without gaps and hold one piece of a power of two."""
    by_doc, want = {}, []
    for r in docs:
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, packing.END_ID]
        start = 0
        for n in packing.lengths(len(ids)):
            want.append((r.doc_id, start, n, zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes()), len(ids)))
            start += n
    assert sorted(((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows), key=repr) == sorted(want, key=repr)
    order = sorted(rows, key=lambda r: r.sequence_id)
    assert [r.sequence_id for r in order] == list(range(len(rows))) and {r.offset for r in rows} <= {0}
    keys = [(-r.length, r.doc_id is not None, r.doc_id or 0, r.start) for r in order]
    assert keys == sorted(keys)
    return by_doc


def test_contract(spark, tmp_path, tokenizer):
    docs = documents(spark, [(30, "a <|endoftext|> b\x1cC", "en", "a"), (31, "word " * 4095, "en", "a"), (32, "word " * 2047, "en", "a")])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_packing(spark, str(tmp_path))
    assert got.dtypes == [(c, "bigint") for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
    check(got.collect(), docs.collect(), tokenizer)


def test_pieces_keep_columns_and_ids(spark, tokenizer):
    docs = spark.createDataFrame([(1, "one two three", "x", "y")], "doc_id int, text string, ids string, note string")
    rows = packing.pieces(docs, queries.word_vocabulary_path()).collect()
    assert rows[0].asDict().keys() == {"doc_id", "note", "start", "length", "ids", "doc_tokens"}
    assert np.frombuffer(b"".join(r.ids for r in sorted(rows, key=lambda r: r.start)), "<u4").tolist() == [*tokenizer.encode("one two three").ids, 1]


def test_empty_table(spark, tmp_path):
    empty(spark).write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.op13_packing(spark, str(tmp_path)).count() == 0
