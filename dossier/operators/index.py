"""A stored index of vectors for retrieval: cells around centres, sorted by cell in folders of Parquet files, read best first.

A cell keeps the least and the largest angle of its vectors to its centre. Since angles are a metric, these and the angle
of a query to the centre bound the cosine that any vector of the cell can have. A search reads cells in the order of their
bounds, a few more each round, until no unread cell's bound reaches the last of its hits: the result is that of a full scan, and
the folders and pages that cannot hold a hit are not read. The better the vectors cluster, the fewer are.

A cell learned at first has a folder of its own, which the parts it is split into share: small cells are not worth a file each.
New vectors go to the cell of the nearest centre; cells that have outgrown their size are split, each into as many as it needs and all
in one pass, so the index is never rebuilt. Each change writes a new version of the small table of cells last: until then readers see the old one. Rows of cells that were
split stay in their folders, unlisted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossier.cuts import cut
from dossier.functions import vectors
from dossier.operators.similar import _matrix, sampled

SAMPLE, CELL_ROWS, MOST_CELLS = 50_000, 1_000, 1_000
FEW_CELLS = 128  # up to so many, all cells are learned together; of more, the square root, which are split then
SPLIT_SAMPLE = 2_000  # rows of a cell that its parts are learned from, about
LEAST_PART = 8  # rows of that sample behind a part, at least about
FILE_ROWS = 65_536
COMPARED = 4_000_000  # rows times centres that a task compares at once
SLACK = 1e-9  # of cosines, against rounding

CELLS = "cell int, folder int, centre array<double>, nearest double, farthest double, rows bigint"


def _unit(v: Column) -> Column:
    # an array of one element binds the length, which every component uses
    return F.flatten(F.transform(F.array(vectors.norm(v)), lambda n: F.transform(v, lambda x: F.try_divide(x.cast("double"), n))))


def _angles(x: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row, and the angle to it."""
    near, step = [], max(1, COMPARED // len(unit))
    for at in range(0, len(x), step):
        cosines = x[at : at + step] @ unit.T
        n = cosines.argmax(1)
        near.append((n, cosines[np.arange(len(n)), n]))
    n, cosine = (np.concatenate(c) for c in zip(*near, strict=True))
    return n, np.arccos(np.clip(cosine, -1, 1))


def _placed(rows: DataFrame, vector: str, ways: dict[int, tuple[list[int], np.ndarray]]) -> DataFrame:
    """rows with the number of the nearest centre and the angle to it, of the (numbers, centres) that ways has for the row's cell, or
    under 0 where rows have no cell yet. The list of cells goes to each task."""
    made = [T.StructField("cell", T.IntegerType()), T.StructField("angle", T.DoubleType())]
    unit = {c: (np.array(n, np.int32), x / np.linalg.norm(x, axis=1, keepdims=True)) for c, (n, x) in ways.items()}
    kept = [c for c in rows.columns if c != "cell"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column(vector))
            old = b.column("cell").to_numpy() if "cell" in b.schema.names else np.zeros(b.num_rows, np.int32)
            cell, angle, order = np.empty(len(x), np.int32), np.empty(len(x)), np.argsort(old, kind="stable")
            for mine in np.split(order, np.flatnonzero(np.diff(old[order])) + 1):
                numbers, centres = unit[int(old[mine[0]])]
                near, angle[mine] = _angles(x[mine], centres)
                cell[mine] = numbers[near]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(cell), pa.array(angle)], names=[*kept, "cell", "angle"])

    return rows.mapInArrow(run, T.StructType([*(f for f in rows.schema.fields if f.name != "cell"), *made]))


def _store(placed: DataFrame, path: str, key: str, listed: dict[int, tuple]) -> None:
    """Rows of listed cells into the folders of these, sorted by cell, a file for about FILE_ROWS rows of a folder."""
    rows: dict[int, int] = {}
    for c in listed.values():
        rows[c[1]] = rows.get(c[1], 0) + c[5]
    folders = [(c[0], c[1], -(-rows[c[1]] // FILE_ROWS) or 1) for c in listed.values()]
    dealt = placed.drop("angle").join(placed.sparkSession.createDataFrame(folders or [(0, 0, 1)], "cell int, cell_folder int, _files int"), "cell")
    dealt = dealt.withColumn("_file", F.pmod(F.xxhash64(key), F.col("_files"))).repartition("cell_folder", "_file").drop("_files", "_file")
    dealt.sortWithinPartitions("cell_folder", "cell").write.mode("append").partitionBy("cell_folder").parquet(f"{path}/rows")


def _sizes(placed: DataFrame) -> DataFrame:
    return placed.groupBy("cell").agg(F.min("angle").alias("nearest"), F.max("angle").alias("farthest"), F.count(F.lit(1)).alias("rows"))


def cells(spark: SparkSession, path: str) -> DataFrame:
    """The cells of the newest version: MOST_CELLS rows and what splits add."""
    versions = spark.read.parquet(f"{path}/cells")
    newest = versions.agg(F.max("version")).first()[0]
    return versions.filter(F.col("version") == newest).drop("version")


def _write_cells(spark: SparkSession, listed: list, path: str, version: int) -> None:
    spark.createDataFrame([tuple(c) for c in listed], CELLS).coalesce(1).withColumn("version", F.lit(version)).write.mode("append").partitionBy("version").parquet(f"{path}/cells")


def build(rows: DataFrame, path: str, vector: str = "embedding", key: str = "chunk_id", seed: int = 5, cell_rows: int | None = None) -> None:
    """Stores rows with a usable vector under path, by cell. The centres are learned on at most about SAMPLE rows."""
    cell_rows = cell_rows or CELL_ROWS
    usable = cut(rows.filter(vectors.flaw(F.col(vector)).isNull()), "usable")
    n = usable.count()
    k = max(1, n // cell_rows)
    k = k if k <= FEW_CELLS else min(MOST_CELLS, max(FEW_CELLS, math.isqrt(k)))
    sample = sampled(usable, SAMPLE, F.col(key), n, seed).select(array_to_vector(_unit(F.col(vector))).alias("features"))
    if k > 1:
        centres = np.array(KMeans(k=k, seed=seed, maxIter=10, distanceMeasure="cosine").fit(sample).clusterCenters())
    else:
        first = usable.select(vector).limit(1).collect()
        centres = np.array([first[0][0] if first else [1.0]], float)
    placed = cut(_placed(usable, vector, {0: (list(range(len(centres))), centres)}), "placed")
    listed = {r.cell: (r.cell, r.cell, centres[r.cell].tolist(), r.nearest, r.farthest, r.rows) for r in _sizes(placed).collect()}  # a row for each cell
    base, moved, listed = _divided(placed.drop("angle"), listed, vector, key, cell_rows)
    _store(reduce(DataFrame.unionByName, moved, base), path, key, listed)
    _write_cells(rows.sparkSession, list(listed.values()) or [(0, 0, centres[0].tolist(), 0.0, 0.0, 0)], path, 1)


def add(rows: DataFrame, path: str, vector: str = "embedding", key: str = "chunk_id", cell_rows: int | None = None) -> None:
    """Stores further rows in the cells of their nearest centres, and splits cells that hold over twice CELL_ROWS."""
    spark, held = rows.sparkSession, {c.cell: c for c in cells(rows.sparkSession, path).collect()}
    placed = cut(_placed(rows.filter(vectors.flaw(F.col(vector)).isNull()), vector, {0: (list(held), np.array([c.centre for c in held.values()]))}), "placed")
    _store(placed, path, key, held)
    new = {r.cell: r for r in _sizes(placed).collect()}
    listed = {c.cell: (c.cell, c.folder, c.centre, min(c.nearest, x.nearest) if c.rows else x.nearest, max(c.farthest, x.farthest), c.rows + x.rows) if (x := new.get(c.cell)) else tuple(c) for c in held.values()}
    _write_cells(spark, list(listed.values()), path, _newest(spark, path) + 1)
    _, moved, divided = _divided(spark.read.parquet(f"{path}/rows").drop("cell_folder"), listed, vector, key, cell_rows or CELL_ROWS)
    if moved:
        _store(reduce(DataFrame.unionByName, moved), path, key, divided)
        _write_cells(spark, list(divided.values()), path, _newest(spark, path) + 1)


def _newest(spark: SparkSession, path: str) -> int:
    return spark.read.parquet(f"{path}/cells").agg(F.max("version")).first()[0]


def _halved(x: np.ndarray) -> np.ndarray | None:
    """Which of two centres, far from each other at first, each row is near to; None where all rows are alike."""
    a = x[int(np.argmin(x @ x[0]))]
    both = np.array([a, x[int(np.argmin(x @ a))]])
    for _ in range(10):
        near = (x @ both.T).argmax(1)
        if len(set(near.tolist())) < 2:
            return None
        both = np.array([x[near == h].mean(0) for h in (0, 1)])
        both /= np.linalg.norm(both, axis=1, keepdims=True)
    return near


def _parts(vector: str, cell_rows: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        """Centres of the parts of a cell's sample, halved until a part stands for about cell_rows rows; none where all vectors are alike."""
        x = np.array(group[vector].tolist(), float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        most = max(LEAST_PART, 1.5 * cell_rows * len(x) / group["rows"].iloc[0])
        left, done = [x], []
        while left:
            part = left.pop()
            near = _halved(part) if len(part) > most or not (left or done) else None
            if near is None:
                done.append(part.mean(0))
            else:
                left += [part[near == 0], part[near == 1]]
        done = [] if len(done) < 2 else done
        return pd.DataFrame({"cell": np.full(len(done), group["cell"].iloc[0], np.int32), "centre": pd.Series(done, dtype=object)})

    return run


def _divided(rows: DataFrame, listed: dict[int, tuple], vector: str, key: str, cell_rows: int) -> tuple[DataFrame, list[DataFrame], dict[int, tuple]]:
    """Splits cells of over twice cell_rows until there is none but those whose vectors are all alike.

    Returns rows in cells that were not split, tables of the rows that have moved to a listed cell, and the cells. Each round splits
    all large cells in one pass; parts keep the folder of their cell.
    """
    spark, whole, moved, listed = rows.sparkSession, set(), [], dict(listed)
    while large := [c for c in listed.values() if c[5] > 2 * cell_rows and c[0] not in whole]:
        own = F.col("cell").isin([c[0] for c in large])
        asked = reduce(DataFrame.unionByName, [m.filter(own) for m in moved], rows.filter(own))
        sizes = spark.createDataFrame([(c[0], c[5]) for c in large], "cell int, rows bigint")
        drawn = F.shiftrightunsigned(F.xxhash64(key, F.lit(9)), 2) < F.least(F.lit(1.0), SPLIT_SAMPLE / F.col("rows")) * 2.0**62
        sample = asked.join(sizes, "cell").filter(drawn).select("cell", "rows", F.col(vector).cast("array<double>").alias(vector))
        ways: dict[int, tuple[list[int], list]] = {}
        number = max(listed) + 1
        for r in sample.groupBy("cell").applyInPandas(_parts(vector, cell_rows), "cell int, centre array<double>").collect():  # a row for each new cell
            numbers, centres = ways.setdefault(r.cell, ([], []))
            numbers.append(number)
            centres.append(r.centre)
            number += 1
        whole |= {c[0] for c in large} - ways.keys()
        if not ways:
            continue
        old = F.col("cell").isin(list(ways))
        placed = cut(_placed(asked.filter(old), vector, {c: (n, np.array(x)) for c, (n, x) in ways.items()}), "split")
        parent = {n: (listed[c], x) for c, (numbers, centres) in ways.items() for n, x in zip(numbers, centres, strict=True)}
        for r in _sizes(placed).collect():
            before, centre = parent[r.cell]
            listed[r.cell] = (r.cell, before[1], list(centre), r.nearest, r.farthest, r.rows)
            if r.rows == before[5]:
                whole.add(r.cell)
        listed = {c: v for c, v in listed.items() if c not in ways}
        rows, moved = rows.filter(~old), [*(m.filter(~old) for m in moved), placed.drop("angle")]
    return rows, moved, listed


@dataclass
class Found:
    """What a search read: cells by their number, and those that hold its hits; the cosine of the last hit."""

    read: list[int]
    cells: int
    holding: list[int]
    last: float


def _bounds(listed: list, query: np.ndarray) -> list[tuple[float, int, int]]:
    """(bound, cell, rows) of each cell, best first: no vector of the cell has a larger cosine to the query."""
    out = []
    for c in listed:
        if c.rows:
            centre = np.array(c.centre)
            angle = math.acos(max(-1.0, min(1.0, float(centre @ query / (np.linalg.norm(centre) * np.linalg.norm(query))))))
            out.append((math.cos(max(0.0, angle - c.farthest, c.nearest - angle)), c.cell, c.rows))
    return sorted(out, key=lambda b: (-b[0], b[1]))


def _scored(rows: DataFrame, query: list[float], chosen: list[int], folder: dict[int, int], threshold: float, where: Column | None, vector: str) -> DataFrame:
    rows = rows.filter(F.col("cell_folder").isin(sorted({folder[c] for c in chosen})) & F.col("cell").isin(chosen)).drop("cell_folder")  # literals, so that the scan lists only these folders
    if where is not None:
        rows = rows.filter(where)
    return rows.withColumn("cosine", vectors.cosine(F.col(vector), vectors.literal(query))).drop(vector).filter(F.col("cosine") > threshold)


def _stored(spark: SparkSession, path: str, listed: list) -> tuple[DataFrame, dict[int, int]]:
    """The stored rows and the folder of each cell."""
    return spark.read.parquet(f"{path}/rows"), {c.cell: c.folder for c in listed}


def find(spark: SparkSession, path: str, query: list[float], count: int, threshold: float = -1.0, where: Column | None = None, vector: str = "embedding", key: str = "chunk_id") -> Found:
    """Reads cells best first until no other can hold one of the `count` best rows above the threshold."""
    listed = cells(spark, path).collect()
    order, (rows, folder) = _bounds(listed, np.array(query, float)), _stored(spark, path, listed)
    hits: list[tuple[float, object, int]] = []
    at, batch = 0, 1
    while at < len(order):
        last = -hits[count - 1][0] if len(hits) >= count else threshold
        ahead = [cell for bound, cell, _ in order[at : at + batch] if bound >= last - SLACK and bound > threshold - SLACK]
        if not ahead:
            break
        best = _scored(rows, query, ahead, folder, threshold, where, vector).orderBy(F.desc("cosine"), key).limit(count).select("cosine", key, "cell").collect()
        hits = sorted([*hits, *((-r.cosine, r[key], r.cell) for r in best)])[:count]
        at, batch = at + len(ahead), batch * 2
    last = -hits[-1][0] if len(hits) >= count else threshold
    return Found([cell for _, cell, _ in order[:at]], len(order), sorted({cell for _, _, cell in hits}), last)


def search(
    spark: SparkSession, path: str, query: list[float], count: int, threshold: float = -1.0, probes: int | None = None, vector: str = "embedding", key: str = "chunk_id", where: Column | None = None
) -> DataFrame:
    """The `count` rows with the largest cosine above the threshold, of those that `where` holds for; ties go to the smaller key.

    Exact; with probes, only that many cells of the nearest centres are read, and hits may be missed.
    """
    if probes is None:
        chosen = find(spark, path, query, count, threshold, where, vector, key).holding
    else:
        question = vectors.literal(query)
        near = cells(spark, path).filter("rows > 0").select("cell", vectors.cosine(F.col("centre"), question).alias("near")).orderBy(F.desc("near"), "cell").limit(probes)
        chosen = [c.cell for c in near.collect()]
    rows, folder = _stored(spark, path, cells(spark, path).select("cell", "folder").collect())
    return _scored(rows, query, chosen, folder, threshold, where, vector).drop("cell").orderBy(F.desc("cosine"), key).limit(count)
