"""Merkle manifests against plain loops."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from dossier.llm import merkle, queries
from tests.llm.data import documents, empty


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row.doc_id, row.source, row.lang, row.n_chars, text)))


def climb(nodes):
    """Levels of nodes up to one."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha("".join(last[i : i + 3])) for i in range(0, len(last), 3)])
    return levels


def path(levels, i):
    """[(left, right)] of each level below the root."""
    out = []
    for level in levels[:-1]:
        run = level[i - i % 3 : i - i % 3 + 3]
        out.append(("".join(run[: i % 3]), "".join(run[i % 3 + 1 :])))
        i //= 3
    return out


def brute(rows):
    groups = {}
    for r in rows:
        spoil = r.doc_id is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 2 == 0
        leaf = leaf_of(r, r.text)
        groups.setdefault((r.source is not None, (r.source or "").encode()), []).append((r.doc_id is not None, r.doc_id or 0, leaf, r.doc_id, leaf_of(r, r.text.replace("\n", "")) if spoil else leaf))
    trees = {k: climb([x[2] for x in sorted(v)]) for k, v in groups.items()}
    top = climb([trees[k][-1][0] for k in sorted(trees)])
    out = []
    for at, k in enumerate(sorted(trees)):
        for i, (_, _, leaf, doc_id, read) in enumerate(sorted(groups[k])):
            steps, node = path(trees[k], i) + path(top, at), read
            for left, right in steps:
                node = sha(left + node + right)
            root = top[-1][0]
            out.append((doc_id, leaf, trees[k][-1][0], root, sha("".join(a + b for a, b in steps)), node, node == root))
    return sorted(out, key=repr)


def run(spark, tmp_path, df):
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_merkle(spark, str(tmp_path))
    assert got.dtypes == [("doc_id", "bigint"), *[(c, "string") for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")], ("verified", "boolean")]
    return sorted(map(tuple, got.collect()), key=repr)


@pytest.mark.parametrize("tier", [1, 2, 6])
def test_equals_plain_loops(spark, tmp_path, monkeypatch, tier):
    """Trees of one and of several blocks; one source holds most rows, others one."""
    monkeypatch.setattr(merkle, "TIER", tier)
    monkeypatch.setattr(merkle, "BLOCK", 3**tier)
    more = [(100 + i, f"line {i}\nand\n{i * 7}", "en", "a" if i % 3 else f"s{i}") for i in range(60)]
    docs = documents(spark, [*more, (500, "ünï\ncode", None, "é"), (501, "x\n", "en", "Z"), (100, "line 0\nand\n0", "en", "s0"), (100, "other", "en", "s0")])
    assert run(spark, tmp_path, docs) == brute(docs.collect())


def test_one_leaf_is_the_root(spark, tmp_path):
    docs = documents(spark).filter("doc_id = 8")
    (row,) = run(spark, tmp_path, docs)
    assert row[1] == row[2] == row[3] and row[4] == sha("") and row[6]


def test_empty_table(spark, tmp_path):
    assert run(spark, tmp_path, empty(spark)) == []


def test_no_more_rows_than_a_block_ask_for_a_node(spark):
    """Coordinates of a proof stay within the block: upper levels are looked up once a block."""
    asked = merkle._siblings(F.col("id").cast("int"), F.lit(merkle.BLOCK), F.lit(merkle.TIER))
    at = spark.range(merkle.BLOCK).select(F.explode(asked).alias("at")).select("at.*")
    counts = [r["count"] for r in at.groupBy("level", "pos").count().collect()]
    assert len(counts) == sum(3**k for k in range(1, merkle.TIER + 1)) and max(counts) == 2 * 3 ** (merkle.TIER - 1)
