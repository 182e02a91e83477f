"""The stored vector index: exact best-first searches, additions and splits."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from dossier.operators import index

SCHEMA = "chunk_id int, kind int, embedding array<double>"


def made(n, seed=3, groups=20, spread=0.15):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, 12))
    return centres[np.arange(n) % groups] + spread * rng.normal(size=(n, 12))


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, i % 3, v.tolist()) for i, v in enumerate(x)], SCHEMA)


def nearest(x, q, count, threshold=-1.0, keep=lambda i: True):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ (q / np.linalg.norm(q))
    return [i for _, i in sorted((-s[i].round(12), i) for i in range(len(x)) if keep(i) and s[i] > threshold)[:count]]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    x, path = made(1200), str(tmp_path_factory.mktemp("index") / "i")
    rows = frame(spark, x).unionByName(spark.createDataFrame([(9000, 0, None), (9001, 0, [0.0] * 12), (9002, 0, [float("nan")] * 12)], SCHEMA))
    index.build(rows, path, cell_rows=50)
    return x, path


@pytest.mark.parametrize("q", [0, 333, 1111])
def test_exact_without_reading_all_cells(spark, stored, q):
    x, path = stored
    for count, threshold, where in ((5, -1.0, None), (60, 0.2, None), (10, -1.0, F.col("kind") == 1), (2000, -1.0, None), (10, 0.9999, None)):
        keep = (lambda i: i % 3 == 1) if where is not None else (lambda i: True)
        want = nearest(x, x[q], count, threshold, keep)
        got = [r.chunk_id for r in index.search(spark, path, x[q].tolist(), count, threshold, where=where).collect()]
        assert got == want
    found = index.find(spark, path, x[q].tolist(), 10)
    assert found.cells > 10 and len(found.read) < found.cells / 2 and set(found.holding) <= set(found.read)


def test_unread_folders_are_pruned(spark, stored):
    x, path = stored
    got = index.search(spark, path, x[7].tolist(), 5)
    assert re.search(r"PartitionFilters: \[[^]]*cell", got._jdf.queryExecution().toString())


def test_additions_split_cells(spark, tmp_path):
    """New vectors are found, also those between the centres; overfull cells are split and the old versions stay."""
    x, path = made(400), str(tmp_path / "i")
    index.build(frame(spark, x), path, cell_rows=100)
    before = {c.cell: c.rows for c in index.cells(spark, path).collect()}
    y = made(900, seed=5)
    index.add(frame(spark, y, 400).unionByName(spark.createDataFrame([(7000, 0, None)], SCHEMA)), path, cell_rows=100)
    after = {c.cell: c.rows for c in index.cells(spark, path).collect()}
    assert sum(after.values()) == 1300 and max(after.values()) <= 200 and len(after) > len(before)
    both = np.vstack([x, y])
    for q in (0, 500, 1299):
        got = [r.chunk_id for r in index.search(spark, path, both[q].tolist(), 20).collect()]
        assert got == nearest(both, both[q], 20)


def test_equal_vectors_cannot_be_split(spark, tmp_path):
    x, path = np.tile(np.arange(1.0, 5.0), (90, 1)), str(tmp_path / "i")
    index.build(frame(spark, x), path, cell_rows=20)
    assert [r.chunk_id for r in index.search(spark, path, x[0].tolist(), 4).collect()] == [0, 1, 2, 3]


def test_empty_index(spark, tmp_path):
    path = str(tmp_path / "i")
    index.build(spark.createDataFrame([(1, 0, None)], SCHEMA), path)
    index.add(frame(spark, made(3)[:, :1] + 9.0), path)
    assert {r.chunk_id for r in index.search(spark, path, [1.0], 5).collect()} == {0, 1, 2}


def test_many_small_cells(spark, tmp_path, monkeypatch):
    """Cells are split into as many as they need, and share folders: far fewer files than cells, and the same hits."""
    monkeypatch.setattr(index, "FEW_CELLS", 16)
    x, path = made(2000, spread=0.4), str(tmp_path / "i")
    index.build(frame(spark, x), path, cell_rows=10)
    held = index.cells(spark, path).collect()
    assert len(held) > 130 and max(c.rows for c in held) <= 20 and sum(c.rows for c in held) == 2000
    files = list((tmp_path / "i" / "rows").rglob("*.parquet"))
    assert len(files) == len({f.parent for f in files}) == len({c.folder for c in held}) <= 16
    for q in (3, 1500):
        assert [r.chunk_id for r in index.search(spark, path, x[q].tolist(), 20).collect()] == nearest(x, x[q], 20)
    found = index.find(spark, path, x[3].tolist(), 5)
    assert len(found.read) < found.cells / 2


def test_filtered_search_of_shared_folders(spark, tmp_path, monkeypatch):
    """Hits that a filter leaves, also of cells that were split into one folder; no row of another cell of it comes twice."""
    monkeypatch.setattr(index, "FEW_CELLS", 4)
    x, path = made(600, seed=8, spread=0.5), str(tmp_path / "i")
    index.build(frame(spark, x), path, cell_rows=10)
    assert len(list((tmp_path / "i" / "rows").rglob("*.parquet"))) <= 8
    for count in (7, 300):
        got = [r.chunk_id for r in index.search(spark, path, x[11].tolist(), count, where=F.col("kind") == 2).collect()]
        assert got == nearest(x, x[11], count, keep=lambda i: i % 3 == 2)
