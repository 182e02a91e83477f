"""Similarity joins, name automata and fuzzy names against plain loops."""

import difflib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dossier.operators import entities, similar
from dossier.plans import QUERIES


def vectors(n, seed=1, groups=12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, 8))
    return centres[rng.integers(groups, size=n)] + 0.25 * rng.normal(size=(n, 8))


def cosines(x):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    return u @ u.T


@pytest.mark.parametrize(("least", "below"), [(0.95, None), (0.8, 0.9), (0.2, 0.4), (-1.0, None)])
def test_self_join(spark, monkeypatch, least, below):
    """All pairs of a band, with copies, repeated rows and vectors that take no part."""
    monkeypatch.setattr(similar, "TILE_ROWS", 16)
    x = vectors(150)
    x[140:] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(3, x[3].tolist()), (900, None), (901, [0.0] * 8), (902, []), (903, [float("nan")] * 8)]
    got = similar.self_join(spark.createDataFrame(rows, "id int, embedding array<double>"), least, below).pairs().collect()
    s = cosines(x)
    s[140:, 140:] = s[0, 140:] = s[140:, 0] = 1.0
    want = {(i, j) for i in range(150) for j in range(i + 1, 150) if s[i, j] >= least and (below is None or s[i, j] < below)}
    assert len(got) == len(want) and {(r.a, r.b) for r in got} == want
    assert all(abs(r.similarity - s[r.a, r.b]) < 1e-9 for r in got)


def test_tiles_are_ruled_out(spark, monkeypatch):
    monkeypatch.setattr(similar, "TILE_ROWS", 32)
    x = vectors(1500, seed=4, groups=40)
    join = similar.self_join(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, embedding array<double>"), 0.97)
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(cosines(x) >= 0.97, 1)), strict=True)}
    assert {(r.a, r.b) for r in join.pairs().collect()} == want
    assert join.share_compared() < 0.5


def test_copies_are_linked_once(spark):
    rows = [(i, [1.0, 0.0]) for i in range(50)] + [(60, [1.0, 0.01]), (61, [0.0, 1.0])]
    join = similar.self_join(spark.createDataFrame(rows, "id int, embedding array<float>"), 0.9)
    assert [tuple(r)[:2] for r in join.representatives().collect()] == [(0, 60)] and join.copies().count() == 49
    assert join.pairs().count() == 50 * 49 // 2 + 50


def test_two_tables(spark, monkeypatch):
    monkeypatch.setattr(similar, "TILE_ROWS", 16)
    x, y = vectors(60, 2), vectors(80, 2)[20:]
    frame = lambda v: spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "id int, embedding array<double>")
    u, w = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (x, y))
    want = {(str(i), str(j)) for i, j in zip(*np.nonzero(u @ w.T >= 0.9), strict=True)}
    assert {(r.a, r.b) for r in similar.join(frame(x), frame(y), 0.9).pairs().collect()} == want


def test_rows_are_sent_by_blocks(spark, monkeypatch):
    """Many blocks of many tiles, the same pairs; a row is copied once for each block, however many tiles there are."""
    monkeypatch.setattr(similar, "TILE_ROWS", 4)
    monkeypatch.setattr(similar, "BLOCK_ROWS", 16)
    monkeypatch.setattr(similar, "OUT_ROWS", 50)
    x = vectors(240, seed=9)
    join = similar.self_join(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, embedding array<float>"), -0.5, 0.9)
    s = cosines(x.astype(np.float32).astype(float))
    assert {(r.a, r.b) for r in join.pairs().collect()} == {(int(i), int(j)) for i, j in zip(*np.nonzero(np.triu((s >= -0.5) & (s < 0.9), 1)), strict=True)}
    tiles = join.tiled.select("tile", "block").distinct().collect()
    assert 15 <= join.blocks <= 27 and {r.block for r in tiles} <= set(range(join.blocks)) and len(tiles) > 2 * join.blocks


def test_pairs_are_not_shuffled(spark, tmp_path):
    """What a task finds is the result: no exchange or join of it where no vector has copies."""
    x = vectors(60)
    spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    plan = QUERIES["j13_similar_pairs"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    after, _, before = plan.partition("MapInArrow")
    assert "Exchange" not in after and "Join" not in after and "Exchange" in before


def test_links_are_fewer_than_pairs(spark):
    """Enough to connect what all pairs connect, at most a row less than the two blocks of each pair of blocks have."""
    x = vectors(300, seed=6, groups=5)
    join = similar.self_join(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, embedding array<double>"), 0.9)
    s, links = cosines(x), [(r.a, r.b) for r in join.links().collect()]

    def least(pairs):
        label = list(range(300))
        for _ in range(300):
            for a, b in pairs:
                label[a] = label[b] = min(label[a], label[b])
        return label

    pairs = [(int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(s >= 0.9, 1)), strict=True)]
    assert all(s[a, b] >= 0.9 - 1e-12 for a, b in links) and least(links) == least(pairs)
    assert len(links) < 300 * join.blocks < len(pairs)


def test_nearest_of_two_tables(spark, monkeypatch):
    """The first place of each left row, copies on both sides, and few other candidates."""
    monkeypatch.setattr(similar, "TILE_ROWS", 8)
    x, y = vectors(80, 3), vectors(160, 5)
    x[70:], y[150:] = x[0], y[7]
    x[5] = y[7]  # its nearest has copies
    frame = lambda v: spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "id int, embedding array<double>")
    join = similar.join(frame(x), frame(y), 0.5)
    got = join.nearest().collect()
    u, w = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (x, y))
    s, first = u @ w.T, {}
    for r in got:
        assert abs(r.similarity - s[int(r.a), int(r.b)]) < 1e-9
        first[int(r.a)] = max(first.get(int(r.a), -1), r.similarity)
    assert first.keys() == {i for i in range(80) if s[i].max() >= 0.5} and all(abs(v - s[i].max()) < 1e-9 for i, v in first.items())
    assert len(got) < (s >= 0.5).sum() / 2 and len({r.b for r in got if int(r.b) in (7, *range(150, 160))}) == 1


def test_no_rows(spark):
    none = spark.createDataFrame([], "id int, embedding array<float>")
    join = similar.self_join(none, 0.5)
    assert join.pairs().count() == join.representatives().count() == join.copies().count() == 0 and join.share_compared() == 0


def test_samples_of_any_size(spark):
    """The rate is a share of 2 ** 62, so a table of 10 ** 11 rows still gives some."""
    rows = spark.range(2_000_000)
    assert 1000 < similar.sampled(rows, 10**8, F.col("id"), 10**11).count() < 3000
    assert similar.sampled(rows, 5_000_000, F.col("id"), 2_000_000) is rows


def test_automaton_finds_all_names():
    """Names within names, names that overlap, repeated ids."""
    rng = random.Random(3)
    words = ["a", "b", "c", "ab"]
    for _ in range(300):
        names = list({" ".join(rng.choices(words, k=rng.randrange(1, 5))) for _ in range(rng.randrange(1, 8))})
        text = rng.choices(words, k=rng.randrange(20))
        want = {i for i, n in enumerate(names) if f" {n} " in f" {' '.join(text)} "}
        assert entities.WordAutomaton([(n, [i]) for i, n in enumerate(names)]).ids(text) == want


def test_texts_are_not_shuffled(spark, monkeypatch):
    """Texts reach the automaton from the scan; what is exchanged has a key and an id. Split registers find the same."""
    texts = spark.createDataFrame([(i, f"the Sea-Owl met RED moon {i} éole") for i in range(30)] + [(99, None), (98, "")], "d int, t string")
    terms = spark.createDataFrame([("sea owl", 1), ("red moon", 2), ("éole", 3), ("moon 7", 4), ("owl", 5), ("red", 6)], "term string, id int")
    found = entities.mentions(texts, terms, "d", "t")
    plan = found._jdf.queryExecution().executedPlan().toString()
    after, _, before = plan.partition("MapInArrow")
    assert "Exchange" in after and "Exchange" not in before
    want = {(i, k) for i in range(30) for k in (1, 2, 3, 5, 6)} | {(7, 4)}
    assert set(map(tuple, found.collect())) == want
    monkeypatch.setattr(entities, "REGISTER_CHARS", 12)
    assert sorted(map(tuple, entities.mentions(texts, terms, "d", "t").collect())) == sorted(want)


@pytest.mark.parametrize("least", [0.7, 0.8, 0.88, 0.95, 1.0])
def test_fuzzy_names_equal_all_pairs(spark, least):
    rng = random.Random(int(least * 100))
    base = ["".join(rng.choices("ABCD ", k=rng.randrange(1, 14))) for _ in range(60)]

    def spoilt(s):
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(s) + 1)
            s = rng.choice((s[:k] + s[k + 1 :], s[:k] + rng.choice("ABCDE") + s[k:], s[:k] + s[k:][::-1]))
        return s

    names, terms = [spoilt(s) for s in base] + base[:5], base
    got = entities.closest_by_blocks(spark.createDataFrame([(n,) for n in names], "candidate string"), spark.createDataFrame([(t,) for t in terms], "term string"), least)
    want = {}
    for n in set(names) - {""}:
        if near := difflib.get_close_matches(n, sorted(set(terms)), n=1, cutoff=least):
            want[n] = (near[0], difflib.SequenceMatcher(None, n, near[0]).ratio())
    assert {r.candidate: (r.term, r.ratio) for r in got.collect()} == want and len(want) > 5
