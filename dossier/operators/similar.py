"""Exact similarity joins of vectors: all pairs whose cosine reaches a threshold, without comparing all pairs.

The angle between vectors is a metric, so |angle(a, p) - angle(b, p)| <= angle(a, b) for any pivot p. Rows are measured
against a few pivots and dealt into tiles of a bounded number of rows near one pivot and at a like distance from it. A tile
keeps the range of its angles to every pivot; two tiles of which one pivot shows that no pair can be near enough are never
compared. Tiles near one pivot lie together in blocks, and rows are sent once to each pair of blocks that has tiles to compare, so
a row is copied as often as there are blocks, not tiles. A task holds the one block and streams the other past it, as matrix
products of tiles; what it finds is given out in batches.

Vectors are reduced to different ones first, and pairs are expanded to the rows that share a vector at the end, so copies
cost no comparisons. Null, empty and zero vectors and those with components that are not finite take no part.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossier.cuts import cut
from dossier.functions import vectors

PIVOTS = 12
PIVOT_SAMPLE = 1_000  # rows that pivots are chosen from, about
TILE_ROWS = 512
BLOCK_ROWS, BLOCK_BYTES = 65_536, 64 << 20  # of a block, which one task holds, at most about: rows, and their components in double precision
MOST_TASKS = 10_000  # more pairs of blocks share tasks, one after the other
OUT_ROWS = 100_000  # pairs of a batch, about
RINGS = 4  # distances from a pivot, in parts of the join's angle
SLACK = 1e-6  # of angles, against rounding


def sampled(rows: DataFrame, bound: int, key: Column, n: int, seed: int = 11) -> DataFrame:
    """About `bound` of n rows at most, by a hash of key in 62 bits: the same rows on every run, and of any n some."""
    if n <= bound:
        return rows
    return rows.filter(F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 2) < int(2**62 * bound / n))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column as unit vectors in double precision."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = np.asarray(column.flatten(), np.float64)
    x = flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def pivots(sample: np.ndarray, most: int = PIVOTS) -> np.ndarray:
    """Vectors of a sample that lie far from each other: each next one is the farthest from those chosen."""
    chosen = [0]
    near = sample @ sample[0]
    while len(chosen) < min(most, len(sample)):
        chosen.append(int(np.argmin(near)))
        near = np.maximum(near, sample @ sample[chosen[-1]])
    return sample[chosen]


def _measured(rows: DataFrame, at: np.ndarray, ring: float) -> DataFrame:
    """rows (rep, vector, ...) with the nearest pivot's number, the ring around it and the angles to all pivots."""
    made = [T.StructField("pivot", T.IntegerType()), T.StructField("ring", T.IntegerType()), T.StructField("angles", T.ArrayType(T.DoubleType()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            angles = np.arccos(np.clip(_matrix(b.column("vector")) @ at.T, -1, 1))
            near = angles.argmin(1)
            rings = (angles[np.arange(len(near)), near] / ring).astype(np.int32)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(angles.ravel()), angles.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.astype(np.int32)), pa.array(rings), lists], names=[*b.schema.names, *[f.name for f in made]])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *made]))


def _tiled(measured: DataFrame, block_rows: int) -> tuple[DataFrame, int]:
    """measured rows with tile and block, and the number of blocks.

    Rows of one side, pivot and ring are dealt by number into as many tiles as TILE_ROWS asks for; tiles of one side and pivot,
    in the order of rings, into as many blocks as block_rows asks for. Blocks are numbered from 0, those of side 0 first.
    """
    group, near = ["side", "pivot", "ring"], Window.partitionBy("side", "pivot")
    numbered = measured.withColumn("_row", F.monotonically_increasing_id())  # of a written table, so it stays
    sizes = measured.groupBy(*group).agg(F.count(F.lit(1)).alias("_rows")).withColumn("_tiles", F.ceil(F.col("_rows") / TILE_ROWS))
    before = F.sum("_tiles").over(near.orderBy("ring")) - F.col("_tiles")
    sizes = cut(sizes.withColumns({"_before": before, "_all": F.sum("_tiles").over(near)}), "sizes")  # a row for each ring of a pivot
    first, blocks = [], 0
    for r in sizes.groupBy("side", "pivot").agg(F.sum("_rows").alias("rows")).orderBy("side", "pivot").collect():  # 2 * PIVOTS rows at most
        n = math.ceil(r.rows / block_rows)
        first += [F.lit(r.side * PIVOTS + r.pivot), F.array(F.lit(blocks), F.lit(n))]
        blocks += n
    dealt = numbered.join(sizes, group).withColumn("_part", F.pmod(F.xxhash64("_row"), F.col("_tiles")))
    held = F.create_map(*first)[F.col("side") * PIVOTS + F.col("pivot")]
    dealt = dealt.withColumn("block", (held[0] + F.floor((F.col("_before") + F.col("_part")) * held[1] / F.col("_all"))).cast("int"))
    return dealt.withColumn("tile", F.concat_ws("-", *group, "_part")).drop("_row", "_rows", "_tiles", "_before", "_all", "_part", "pivot", "ring"), blocks


def _tile_pairs(tiled: DataFrame, angle: float, n_pivots: int, both: bool) -> DataFrame:
    """(a, b, their blocks, rows compared) of all tiles that may hold a pair within the angle; of one table a <= b, of two a on the left and b on the right."""
    ends = [f(F.col("angles")[k]).alias(f"{name}{k}") for k in range(n_pivots) for name, f in (("lo", F.min), ("hi", F.max))]
    tiles = tiled.groupBy("tile", "side", "block").agg(F.count(F.lit(1)).alias("rows"), *ends)
    # tiles meet by stretches of the first pivot's angle: a's own, b's widened by the angle
    reach = lambda lo, hi: F.sequence(F.floor(lo / angle), F.floor(hi / angle))
    a = tiles.withColumns({"cell": F.explode(reach(F.col("lo0"), F.col("hi0"))), "least": F.floor(F.col("lo0") / angle)}).alias("a")
    b = tiles.withColumns({"cell": F.explode(reach(F.col("lo0") - angle - SLACK, F.col("hi0") + angle + SLACK)), "least": F.floor((F.col("lo0") - angle - SLACK) / angle)}).alias("b")
    once = F.col("a.cell") == F.greatest("a.least", "b.least")
    order = (F.col("a.side") == 0) & (F.col("b.side") == 1) if both else F.col("a.tile") <= F.col("b.tile")
    near = (F.col("a.cell") == F.col("b.cell")) & once & order
    for k in range(n_pivots):
        apart = F.greatest(F.col(f"a.lo{k}") - F.col(f"b.hi{k}"), F.col(f"b.lo{k}") - F.col(f"a.hi{k}"))
        near = near & (apart <= angle + SLACK)
    return a.join(b, near).select(F.col("a.tile").alias("a"), F.col("b.tile").alias("b"), F.col("a.block").alias("a_block"), F.col("b.block").alias("b_block"), (F.col("a.rows") * F.col("b.rows")).alias("compared"))


class _Tile:
    """Rows of a tile in one task: ids, unit vectors, the ranges of their angles to the pivots, their first number in the pair of blocks."""

    def __init__(self, rep: pa.Array, vector: pa.Array, at: np.ndarray, first: int):
        self.rep, self.x, self.first = rep, _matrix(vector), first
        angles = np.arccos(np.clip(self.x @ at.T, -1, 1))
        self.lo, self.hi = angles.min(0), angles.max(0)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, bool, int], pa.Array, pa.Array]]:
    """(pair, own, end), ids and vectors of one tile after the other, of rows sorted by pair, end and tile."""
    key, parts = None, []
    for b in batches:
        marks = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("pair", "own", "end", "tile")], 1)
        starts = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(1)) + 1).tolist(), len(marks)]
        for lo, hi in zip(starts[:-1], starts[1:], strict=True):
            if lo == hi:
                continue
            mine = tuple(marks[lo].tolist())
            if mine != key and parts:
                yield key[:3], *(pa.concat_arrays(p) for p in zip(*parts, strict=True))
                parts = []
            key = mine
            parts.append((b.column("rep").slice(lo, hi - lo), b.column("vector").slice(lo, hi - lo)))
    if parts:
        yield key[:3], *(pa.concat_arrays(p) for p in zip(*parts, strict=True))


class _All:
    """What a pair of blocks gives: every pair found."""

    def add(self, left: _Tile, right: _Tile, sims: np.ndarray, keep: np.ndarray) -> Iterator[tuple]:
        i, j = np.nonzero(keep)
        if len(i):
            yield left.rep.take(pa.array(i)), right.rep.take(pa.array(j)), sims[i, j]

    def end(self) -> Iterator[tuple]:
        yield from ()


class _Forest:
    """Of the pairs found, those that connect what was not connected: fewer than a pair of blocks has rows."""

    def __init__(self):
        self.root = np.arange(0)

    def add(self, left: _Tile, right: _Tile, sims: np.ndarray, keep: np.ndarray) -> Iterator[tuple]:
        i, j = np.nonzero(keep)
        most = max(left.first + len(left.x), right.first + len(right.x))
        root = self.root = np.concatenate([self.root, np.arange(len(self.root), most)])
        u, v = i + left.first, j + right.first
        kept = []
        for k in np.flatnonzero(root[u] != root[v]).tolist():
            a, b = int(u[k]), int(v[k])
            while root[a] != a:
                a = root[a]
            while root[b] != b:
                b = root[b]
            if a != b:
                root[max(a, b)] = min(a, b)
                kept.append(k)
        if kept:
            while (root[root] != root).any():
                root[:] = root[root]
            yield left.rep.take(pa.array(i[kept])), right.rep.take(pa.array(j[kept])), sims[i[kept], j[kept]]

    def end(self) -> Iterator[tuple]:
        yield from ()


class _Best:
    """Of each row on the left, the pairs with its most similar rows on the right: those of the first place alone."""

    def __init__(self):
        self.best, self.found = np.zeros(0), []

    def add(self, left: _Tile, right: _Tile, sims: np.ndarray, keep: np.ndarray) -> Iterator[tuple]:
        self.best = np.concatenate([self.best, np.full(max(0, left.first + len(left.x) - len(self.best)), -np.inf)])
        mine = self.best[left.first : left.first + len(left.x)]
        sims = np.where(keep, sims, -np.inf)
        np.maximum(mine, sims.max(1), out=mine)
        i, j = np.nonzero(keep & (sims == mine[:, None]))
        if len(i):
            self.found.append((i + left.first, left.rep.take(pa.array(i)), right.rep.take(pa.array(j)), sims[i, j]))
        yield from ()

    def end(self) -> Iterator[tuple]:
        for n, a, b, sims in self.found:
            first = np.flatnonzero(sims == self.best[n])
            yield a.take(pa.array(first)), b.take(pa.array(first)), sims[first]


def _compared(tiled: DataFrame, pairs: DataFrame, blocks: int, at: np.ndarray, angle: float, least: float, below: float | None, kind: str, what: Callable) -> DataFrame:
    """(a, b, similarity) of the representatives of all pairs of blocks, as `what` chooses them.

    A task holds the tiles of the pair's one block, and a tile of the other at a time.
    """
    end = lambda block, n: F.struct(F.col(block).alias("block"), F.lit(n).alias("end"))
    asked = pairs.select(F.least("a_block", "b_block").alias("p"), F.greatest("a_block", "b_block").alias("q")).distinct()
    own = F.col("p") == F.col("q")
    number = F.expr("q * (q + 1L) div 2 + p")
    asked = asked.select(number.alias("pair"), own.alias("own"), F.explode(F.when(own, F.array(end("p", 0))).otherwise(F.array(end("p", 0), end("q", 1)))).alias("x"))
    asked = cut(asked.select("pair", "own", "x.*"), "blocks")  # two rows for each pair of blocks
    rows = tiled.select("block", F.xxhash64("tile").alias("tile"), "rep", "vector").join(asked, "block").select("pair", "own", "end", "tile", "rep", "vector")
    tasks = min(MOST_TASKS, blocks * (blocks + 1) // 2)
    dealt = rows.repartitionById(tasks, F.pmod("pair", F.lit(tasks)).cast("int")).sortWithinPartitions("pair", "end", "tile")

    def compare(left: _Tile, right: _Tile, chosen) -> Iterator[tuple]:
        if (np.maximum(left.lo - right.hi, right.lo - left.hi) > angle + SLACK).any():
            return
        sims = left.x @ right.x.T
        keep = sims >= least
        if below is not None:
            keep &= sims < below
        if left is right:
            keep &= np.triu(np.ones_like(keep), 1)
        if keep.any():
            yield from chosen.add(left, right, sims, keep)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        now, chosen, held, n = None, what(), [], 0
        for (pair, own, end), rep, vector in _segments(batches):
            if pair != now:
                yield from chosen.end()
                now, chosen, held, n = pair, what(), [], 0
            tile = _Tile(rep, vector, at, n)
            n += len(tile.x)
            if end == 0:
                held.append(tile)
            if own or end == 1:
                for left in held:
                    yield from compare(left, tile, chosen)
        yield from chosen.end()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0
        batch = lambda: pa.RecordBatch.from_arrays([pa.concat_arrays([p[0] for p in parts]), pa.concat_arrays([p[1] for p in parts]), pa.array(np.concatenate([p[2] for p in parts]))], names=["a", "b", "similarity"])
        for part in found(batches):
            parts.append(part)
            n += len(part[2])
            if n >= OUT_ROWS:
                yield batch()
                parts, n = [], 0
        if n:
            yield batch()

    return dealt.mapInArrow(run, f"a {kind}, b {kind}, similarity double")


class Join:
    """A prepared join: different vectors in tiles, and the pairs of tiles that are left to compare."""

    def __init__(self, rows: DataFrame, least: float, below: float | None, both: bool):
        """rows: side (0 or 1), id, vector."""
        self.least, self.below, self.both = least, below, both
        usable = rows.filter(vectors.flaw(F.col("vector")).isNull())
        self.members = cut(usable.groupBy("side", "vector").agg(F.min("id").alias("rep"), F.collect_set("id").alias("ids")), "vectors")
        self.many = cut(self.members.filter(F.size("ids") > 1).select("side", "rep", "ids"), "copies")
        self.copied = not self.many.isEmpty()
        self.kind = rows.schema["id"].dataType.simpleString()
        self.n = self.members.count()
        different = self.members.select("side", "rep", "vector")
        angle = math.acos(max(-1.0, min(1.0, least)))
        self.angle = max(angle, 1e-3)
        sample = sampled(different, PIVOT_SAMPLE, F.col("rep"), self.n).select("vector").limit(4 * PIVOT_SAMPLE).toArrow().column("vector")
        if self.n:
            at = self.at = pivots(_matrix(sample)) if len(sample) else np.ones((1, 1))
            measured = cut(_measured(different, at, self.angle / RINGS), "measured")
            self.tiled, self.blocks = _tiled(measured, max(TILE_ROWS, min(BLOCK_ROWS, BLOCK_BYTES // (8 * at.shape[1]))))
            self.tiles = cut(_tile_pairs(self.tiled, self.angle, len(at), both), "tiles")

    def share_compared(self) -> float:
        """The share of all pairs of different vectors that is compared, the rest being ruled out by tiles."""
        sides = {r["side"]: r["count"] for r in self.members.groupBy("side").count().collect()}
        whole = sides.get(0, 0) * sides.get(1, 0) if self.both else sides.get(0, 0) ** 2 / 2
        each = F.when(F.col("a") == F.col("b"), F.col("compared") / 2).otherwise(F.col("compared"))
        return (self.tiles.agg(F.sum(each)).first()[0] or 0.0) / max(whole, 1) if self.n else 0.0

    def _found(self, what: Callable) -> DataFrame:
        if not self.n:
            return self.members.sparkSession.createDataFrame([], f"a {self.kind}, b {self.kind}, similarity double")
        return _compared(self.tiled, self.tiles, self.blocks, self.at, self.angle, self.least, self.below, self.kind, what)

    def representatives(self) -> DataFrame:
        """(a, b, similarity): pairs of the smallest ids of different vectors."""
        return self._found(_All)

    def links(self) -> DataFrame:
        """(a, b, similarity): of these pairs, enough to connect what they connect, fewer than the rows of each pair of blocks."""
        return self._found(_Forest)

    def copies(self) -> DataFrame:
        """(rep, id) of rows that share a representative's vector; not the representative itself."""
        return self.many.select("side", "rep", F.explode("ids").alias("id")).filter("id <> rep")

    def _expanded(self, found: DataFrame, right: DataFrame) -> DataFrame:
        """found with each representative's rows in its place; right: b, bs. Vectors of one row are in neither table."""
        if not self.copied:
            return found
        left = self.many.filter("side = 0").select(F.col("rep").alias("a"), F.col("ids").alias("as"))
        each = found.join(left, "a", "left").join(right, "b", "left")
        each = each.select(F.explode(F.coalesce("as", F.array("a"))).alias("a"), F.coalesce("bs", F.array("b")).alias("bs"), "similarity")
        return each.select("a", F.explode("bs").alias("b"), "similarity")

    def nearest(self) -> DataFrame:
        """(a, b, similarity): of two tables, candidates for each left row's most similar right row, a few a row; of right rows that share
        a vector the one with the least hash."""
        ids = self.many.filter("side = 1").select(F.col("rep").alias("b"), F.explode("ids").alias("id"))
        return self._expanded(self._found(_Best), ids.groupBy("b").agg(F.array(F.min_by("id", F.xxhash64("id"))).alias("bs")))

    def pairs(self) -> DataFrame:
        """(a, b, similarity) of all rows; of one table a < b."""
        right = self.many.filter(F.col("side") == (1 if self.both else 0)).select(F.col("rep").alias("b"), F.col("ids").alias("bs"))
        each = self._expanded(self.representatives(), right)
        if self.both:
            return each
        each = each.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity").filter("a < b")
        if not self.copied or self.least > 1 or (self.below is not None and self.below <= 1):
            return each
        same = self.many.select(F.explode("ids").alias("a"), "ids").select("a", F.explode("ids").alias("b")).filter("a < b")
        return each.unionByName(same.withColumn("similarity", F.lit(1.0)))


def self_join(rows: DataFrame, least: float, below: float | None = None, key: str = "id", vector: str = "embedding") -> Join:
    return Join(rows.select(F.lit(0).alias("side"), F.col(key).alias("id"), F.col(vector).alias("vector")), least, below, False)


def join(left: DataFrame, right: DataFrame, least: float, left_key: str = "id", right_key: str = "id", vector: str = "embedding") -> Join:
    """Both sides' keys as text, as they may differ in type."""
    side = lambda df, n, key: df.select(F.lit(n).alias("side"), F.col(key).cast("string").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    return Join(side(left, 0, left_key).unionByName(side(right, 1, right_key)), least, None, True)
