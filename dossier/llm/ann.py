"""Approximate nearest neighbours by learned partitions.

A neighbour graph over a bounded sample of a part's vectors is cut into balanced parts; a softmax classifier learns to name
the part of a vector. Every vector is stored in its likeliest part, every query searches its likeliest parts, whose number
is chosen on the sample so that their neighbours are found. All vectors are one part at first; parts of over 4 * PART_ROWS rows
are split so again, level by level, each by a classifier of its own that a task trains, so parts stay of one size however
large the table is and the work grows with the rows, not with their square. What a query finds is ranked by exact cosine in
double precision.

Equal vectors are searched as one, with their smallest ids: exact, since a result of k can hold no more of them than k + 1.
Parts are dealt into blocks of bounded size on both sides, so no task grows with a part that cannot be split.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part; vectors of another length
than the most frequent one (of equally frequent ones, the shorter) take no part; ties in score go to the smaller id, among
all vectors of the searched parts, however many are tied; repeated ids are candidates once per different vector; a row
without id takes no part; further columns of the table are not read, whatever their names; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.common import cut, in_sample

SAMPLE, GRAPH_K = 6_000, 10  # rows that a part's classifier is trained on at most
PART_ROWS, MOST_PARTS = 64, 256  # of one split; a part of over 4 * PART_ROWS is split further
TARGET = 0.965  # of the sample's neighbours that the searched parts must hold, all levels together
BLOCK = 4096  # rows of a part in one group, on either side
ROUTED = 20_000  # rows that one task routes at a time
ROUNDING = 1e-12  # more than a cosine of unit vectors can be off
EPOCHS, BATCH, RATE = 40, 256, 0.02


@dataclass
class Router:
    weights: np.ndarray  # (dim, parts)
    bias: np.ndarray
    probes: int


def unit(x: np.ndarray) -> np.ndarray:
    scaled = x / np.abs(x).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """(n, k): the nearest other rows by cosine; x has unit rows."""
    out = np.zeros((len(x), k), np.int64)
    for at in range(0, len(x), 1024):
        near = x[at : at + 1024] @ x.T
        near[np.arange(len(near)), np.arange(at, at + len(near))] = -np.inf
        out[at : at + 1024] = np.argpartition(-near, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 8) -> np.ndarray:
    """The part of each row: halves along the main direction again and again, then moves along the graph's edges within
    a part's capacity."""
    label = np.zeros(len(x), np.int64)
    for level in range(int(np.log2(parts))):
        for p in range(1 << level):
            mine = np.nonzero(label == p)[0]
            if len(mine) < 2:
                continue
            centred = x[mine] - x[mine].mean(axis=0)
            main = np.linalg.eigh(centred.T @ centred)[1][:, -1]
            order = mine[np.argsort(centred @ main, kind="stable")]
            label[order[len(order) // 2 :]] = p + (1 << level)
    sizes, most = np.bincount(label, minlength=parts), int(np.ceil(1.2 * len(x) / parts))
    edges = [[] for _ in range(len(x))]
    for i, row in enumerate(graph):
        for j in row.tolist():
            edges[i].append(j)
            edges[j].append(i)
    for _ in range(rounds):
        moved = 0
        for i, near in enumerate(edges):
            votes = np.bincount(label[near], minlength=parts)
            old = label[i]
            votes[(sizes >= most) & (np.arange(parts) != old)] = -1
            new = int(votes.argmax())
            if votes[new] > votes[old]:
                label[i], moved = new, moved + 1
                sizes[old] -= 1
                sizes[new] += 1
        if not moved:
            break
    return label


def log_parts(x: np.ndarray, r: Router) -> np.ndarray:
    return x @ r.weights + r.bias


def train_router(x: np.ndarray, parts: int, seed: int = 3, target: float = TARGET) -> Router:
    """x: unit rows. Soft targets: where a row and its neighbours lie."""
    n, k = len(x), min(GRAPH_K, len(x) - 1)
    if k < 1 or parts < 2:
        return Router(np.zeros((x.shape[1], 1)), np.zeros(1), 1)
    graph = neighbour_graph(x, k)
    label = balanced_parts(x, graph, parts)
    wanted = np.zeros((n, parts), np.float32)
    np.add.at(wanted, (np.arange(n), label), 2.0)
    for j in range(k):
        np.add.at(wanted, (np.arange(n), label[graph[:, j]]), 1.0)
    wanted /= wanted.sum(axis=1, keepdims=True)
    rng = np.random.default_rng(seed)
    w, b = np.zeros((x.shape[1], parts)), np.zeros(parts)
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)]
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(n)
        for at in range(0, n, BATCH):
            rows = order[at : at + BATCH]
            z = x[rows] @ w + b
            e = np.exp(z - z.max(axis=1, keepdims=True))
            g = (e / e.sum(axis=1, keepdims=True) - wanted[rows]) / len(rows)
            step += 1
            rate = RATE * (1 - 0.9 * epoch / EPOCHS) * 5
            for value, grad, m, v in ((w, x[rows].T @ g, moments[0], moments[1]), (b, g.sum(axis=0), moments[2], moments[3])):
                m *= 0.9
                m += 0.1 * grad
                v *= 0.999
                v += 0.001 * grad * grad
                value -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    router = Router(w, b, parts)
    ranked = np.argsort(-log_parts(x, router), axis=1)
    stored = ranked[:, 0]
    place = np.argsort(ranked, axis=1)  # of each part in a row's order
    reach = np.sort(place[np.arange(n)[:, None], stored[graph[:, : min(5, k)]]].ravel())
    router.probes = int(reach[min(len(reach) - 1, int(np.ceil(target * len(reach))))]) + 1
    return router


def vectors_of(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 1))


def _smallest_ids(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of equal vectors in a batch, the k smallest different ids."""
        for b in batches:
            first: dict[bytes, dict[int, int]] = {}
            x = vectors_of(b.column("vector"))
            for i, (row, v) in enumerate(zip(x, b.column("vec_id").to_pylist(), strict=True)):
                first.setdefault(row.tobytes(), {}).setdefault(v, i)
            keep = sorted(i for rows in first.values() for _, i in sorted(rows.items())[:k])
            yield b.take(pa.array(keep, pa.int64()))

    return run


def distinct_vectors(valid: DataFrame, k: int) -> DataFrame:
    """vector, gid (its smallest id), ids: its k smallest different ids. Partial results first, in two steps, so that no
    list grows with the number of copies."""
    few = valid.mapInArrow(_smallest_ids(k), valid.schema)
    least = lambda ids: F.slice(F.sort_array(F.array_distinct(ids)), 1, k)
    salted = few.groupBy("vector", F.pmod(F.xxhash64("vec_id"), F.lit(64)).alias("salt")).agg(least(F.collect_list("vec_id")).alias("ids"))
    return salted.groupBy("vector").agg(least(F.flatten(F.collect_list("ids"))).alias("ids")).withColumn("gid", F.col("ids")[0])


def parts_of(rows: int, sampled: int, part_rows: int) -> int:
    """Into how many parts a part is split: a power of two."""
    return 1 << max(1, min(int(np.log2(MOST_PARTS)), round(np.log2(rows / part_rows)), int(np.log2(sampled / 8 + 1))))


def levels(rows: int, part_rows: int) -> int:
    """How often rows are split until their parts are small enough, at MOST_PARTS a split."""
    return max(1, int(np.ceil(np.log(max(rows, 1) / (4 * part_rows)) / np.log(MOST_PARTS))))


def _trained(part_rows: int, target: float):
    def run(group: pa.Table) -> pa.Table:
        """The classifier of one part, from its sampled vectors: one row."""
        group = group.sort_by("gid")
        router = train_router(unit(vectors_of(group["vector"])), parts_of(group["n"][0].as_py(), group.num_rows, part_rows), target=target)
        made = [router.weights.shape[1]], [router.probes], [router.weights.astype("<f4").tobytes()], [router.bias.astype("<f4").tobytes()]
        return pa.table([group["part"].slice(0, 1), *map(pa.array, made)], names=["part", "parts", "probes", "weights", "bias"]).cast(pa.schema(ROUTER_FIELDS))

    return run


ROUTER_FIELDS = [("part", pa.int64()), ("parts", pa.int32()), ("probes", pa.int32()), ("weights", pa.binary()), ("bias", pa.binary())]
ROUTER = "part bigint, parts int, probes int, weights binary, bias binary"


def _routed(stored: bool, row: list[str]):
    def run(rows: pa.Table, routers: pa.Table) -> pa.Table:
        """Rows of one part with the numbers of their likeliest parts in it: one for a stored row, several for a query."""
        rows = rows.select([*row, "part"])
        if not rows.num_rows:
            return rows
        r = {c: routers[c][0].as_py() for c in routers.column_names}
        weights, bias = (np.frombuffer(r[c], "<f4").reshape(-1, r["parts"]).astype(np.float64) for c in ("weights", "bias"))
        z = log_parts(unit(vectors_of(rows["vector"])), Router(weights, bias[0], r["probes"]))
        order = np.argsort(-z, axis=1, kind="stable")[:, : 1 if stored else r["probes"]]
        at = np.repeat(np.arange(rows.num_rows), order.shape[1])
        return rows.take(pa.array(at)).set_column(len(row), "part", pa.array(r["part"] * RADIX + 1 + order.ravel(), pa.int64()))

    return run


RADIX = 2 * MOST_PARTS  # of the digits that a part's number gains when it is split


def _route(side: DataFrame, key: str, routers: DataFrame, large: DataFrame, stored: bool, name: str) -> DataFrame:
    """side with the rows of split parts in their new ones. A part's rows are dealt to as many tasks as it needs."""
    row = [c for c in side.columns if c != "part"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in side.select(*row, "part").schema)
    shares = cut(side.groupBy("part").agg(F.ceil(F.count("*") / ROUTED).cast("int").alias("tasks")).join(large.select("part"), "part"), "tasks")
    dealt = side.join(shares, "part").withColumn("task", F.pmod(F.xxhash64(key), F.col("tasks")).cast("int")).drop("tasks")
    guides = routers.join(shares, "part").withColumn("task", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1))).drop("tasks")
    moved = dealt.groupBy("part", "task").cogroup(guides.groupBy("part", "task")).applyInArrow(_routed(stored, row), schema)
    return cut(moved.unionByName(side.join(large.select("part"), "part", "left_anti")), name)


def partitioned(stored: DataFrame, sent: DataFrame, sample: int, part_rows: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with the column part: stored (vector, ids, gid) in one part each, sent (qid, vector) in all they search.

    One round per level: parts of over 4 * part_rows rows are split, unless their last split left nearly all rows together.
    """
    stored, sent = stored.withColumn("part", F.lit(1).cast("bigint")), sent.withColumn("part", F.lit(1).cast("bigint"))
    before, target = None, TARGET ** (1 / levels(stored.count(), part_rows))
    while True:
        large = stored.groupBy("part").agg(F.count("*").alias("n")).filter(F.col("n") > 4 * part_rows)
        if before is not None:
            large = large.join(before.select(F.col("part").alias("parent"), F.col("n").alias("whole")), F.expr(f"part div {RADIX}") == F.col("parent"))
            large = large.filter(F.col("n") < 0.9 * F.col("whole")).select("part", "n")
        before = large = cut(large, "parts")
        if large.isEmpty():
            return stored, sent
        taken = in_sample(F.col("gid"), sample, F.col("n"))
        sampled = stored.join(large, "part").filter(taken).select("part", "gid", "vector", "n")
        routers = cut(sampled.groupBy("part").applyInArrow(_trained(part_rows, target), ROUTER), "routers")
        large = routers.select("part")  # a part without a sampled row stays as it is
        stored, sent = _route(stored, "gid", routers, large, True, "stored"), _route(sent, "qid", routers, large, False, "sent")


def _block_search(k: int):
    def nearest(queries: pa.Table, found: pa.Table, hits: dict[int, list]) -> None:
        """The k nearest of each query in one part, ties to smaller ids: those that rounding may have put behind the k-th included."""
        q, c = vectors_of(queries["vector"]), vectors_of(found["vector"])
        uq, uc = unit(q), unit(c)
        ids, qids = found["ids"].to_pylist(), queries["qid"].to_pylist()
        for at in range(0, len(q), 512):
            near = uq[at : at + 512] @ uc.T
            m = min(near.shape[1], k)
            least = np.partition(near, near.shape[1] - m, axis=1)[:, near.shape[1] - m]
            for i, row in enumerate(near):
                best = np.flatnonzero(row >= least[i] - ROUNDING)
                a, b = q[at + i], c[best]
                scores = (b * a).sum(axis=1) / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum(axis=1)))
                held = hits.setdefault(qids[at + i], [])
                held += [(-s, v) for s, j in zip(scores.tolist(), best.tolist(), strict=True) for v in ids[j]]
                held.sort()
                del held[k:]

    def run(queries: pa.Table, found: pa.Table) -> pa.Table:
        """The k nearest of each query in the parts of a bundle that it searches."""
        hits: dict[int, list] = {}
        if queries.num_rows and found.num_rows:
            asked, held = queries["part"].to_numpy(), found["part"].to_numpy()
            for part in np.intersect1d(asked, held):
                nearest(queries.filter(pa.array(asked == part)), found.filter(pa.array(held == part)), hits)
        rows = [(qid, v, -s) for qid, best in hits.items() for s, v in best]
        qid, vec_id, score = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.table({"qid": pa.array(qid, pa.int64()), "vec_id": pa.array(vec_id, pa.int64()), "score": pa.array(score, pa.float64())})

    return run


def search(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE, part_rows: int = PART_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row for which is_query holds, among all other rows."""
    v = F.col("vector")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = v.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0) & F.col("vec_id").isNotNull()
    valid = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector")).filter(usable)
    widths = valid.groupBy(F.size("vector").alias("w")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(1).collect()
    valid = valid.filter(F.size("vector") == (widths[0].w if widths else 0))
    groups = cut(distinct_vectors(valid, k + 1), "vectors")
    asked = groups.join(valid.filter(is_query(F.col("vec_id"))).select("vector").distinct(), "vector").select(F.col("gid").alias("qid"), "vector")
    stored, sent = partitioned(groups.select("vector", "ids", "gid"), cut(asked, "asked"), sample, part_rows)

    pieces = lambda side: side.groupBy("part").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("m"))
    both = pieces(stored).select("part", F.col("m").alias("c_blocks")).join(pieces(sent).select("part", F.col("m").alias("q_blocks")), "part")
    # small parts go to a task together, in bundles of about BLOCK rows, so a query brings its best of a bundle and not of each part
    bundles = max(1, -(-max(stored.count(), sent.count()) // BLOCK))
    alone = (F.col("c_blocks") > 1) | (F.col("q_blocks") > 1)
    bundle = F.when(alone, -F.col("part")).otherwise(F.pmod(F.xxhash64("part"), F.lit(bundles)))
    both = cut(both.withColumn("bundle", bundle), "blocks")  # written, so its size is known when the joins are planned
    own = lambda key, count: F.pmod(F.xxhash64(key), F.col(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    left = sent.join(both, "part").withColumn("q", own("qid", "q_blocks")).withColumn("c", every("c_blocks")).drop("q_blocks", "c_blocks")
    right = stored.join(both, "part").withColumn("c", own("gid", "c_blocks")).withColumn("q", every("q_blocks")).drop("q_blocks", "c_blocks")
    right = right.withColumn("bundle", F.col("bundle") + 0)  # a column of its own, as both sides hold the other one
    key = ["bundle", "q", "c"]
    hits = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_block_search(k + 1), "qid bigint, vec_id bigint, score double")
    best = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id"))), 1, k + 1)
    top = cut(hits.groupBy("qid").agg(best.alias("top")), "top")
    vectors_top = groups.join(top, groups.gid == top.qid).select("vector", "top")
    asking = valid.filter(is_query(F.col("vec_id"))).select(F.col("vec_id").alias("query_id"), "vector").distinct()
    others = F.slice(F.filter("top", lambda t: t["vec_id"] != F.col("query_id")), 1, k)
    return (
        asking.join(vectors_top, "vector")
        .select("query_id", F.posexplode(others).alias("at", "hit"))
        .select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.far")).alias("score"))
    )
