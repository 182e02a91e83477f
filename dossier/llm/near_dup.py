"""SimHash near-duplicates by pivot distance tables.

1. A fingerprint per document: the bits set in over half of the XXH64 hashes (seed 42) of its 3-word shingles.
2. Equal fingerprints become one row, so exact copies cost nothing further.
3. Each fingerprint gets its Hamming distances to PIVOTS reference fingerprints. The references differ from the first one
   in one block of bits each, so differences of two distances are distances within blocks, and for a pair within RADIUS
   bits at most RADIUS of these BLOCKS values differ. With the values in four groups, two groups agree: rows that share
   two groups are candidates. Candidates whose tables differ by more than RADIUS in any coordinate are discarded, the rest
   are verified on the fingerprints.
4. Buckets of over LARGE distinct fingerprints are not paired: each of their members joins the 65 fingerprints within one
   bit of it instead. Two fingerprints within two bits share such a point and no others do, so this is exact and linear.
5. Links are contracted to stars (alternating large and small stars) until nothing changes; a component's id is its smallest
   doc_id.

Defined cases: a null or empty text has fingerprint 0 and is linked like any other; a very long text is hashed whole, SLICE
shingles at a time; a bit set in exactly half of the hashes is 0; repeated rows are rows of their own; a null doc_id never
names a component (null if it has no other); other columns may have any name; an empty table gives an empty result.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.llm.common import cut, row_hash
from dossier.operators.components import components

SHINGLE, SEED, RADIUS = 3, 42, 2
BLOCKS, GROUPS = 32, 4
LARGE = 64
SLICE = 1 << 16  # shingles hashed at a time


def fingerprint(text: str | None) -> int:
    """The unsigned 64-bit fingerprint of one text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(SHINGLE, len(words))
    starts, ends = starts[: len(words) - k + 1], ends[k - 1 :]
    hashed, n, ones = xxhash.xxh64_intdigest, len(starts), np.zeros(64, np.int64)
    for at in range(0, n, SLICE):
        h = np.array([hashed(joined[a:b], SEED) for a, b in zip(starts[at : at + SLICE].tolist(), ends[at : at + SLICE].tolist())], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        prints = np.array([fingerprint(t.as_py()) for t in b.column(1)], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints, pa.int64()), b.column(2)], names=["doc_id", "fp", "row_key"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp and row_key (a hash of all columns) for each row."""
    slim = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), row_hash(docs).alias("row_key"))
    return slim.mapInArrow(_fingerprints, "doc_id bigint, fp bigint, row_key bigint")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def pivots(seed: int = 1) -> list[int]:
    """The first reference and, for each block of bits, one that differs from it in that block alone."""
    first, width = random.Random(seed).getrandbits(64), 64 // BLOCKS
    return [first] + [first ^ sum(1 << (j + BLOCKS * w) for w in range(width)) for j in range(BLOCKS)]


def distance_table(fp: Column) -> Column:
    return F.array(*[F.bit_count(fp.bitwiseXOR(F.lit(_signed(p)).cast("bigint"))).cast("tinyint") for p in pivots()])


def bucket_keys(table: Column) -> Column:
    """For each pair of groups, a key of the block distances in both."""
    width, per = 64 // BLOCKS, BLOCKS // GROUPS

    def group(g: int) -> Column:
        blocks = range(g * per, (g + 1) * per)
        return sum(((F.get(table, F.lit(0)) - F.get(table, F.lit(j + 1)) + width) / 2).cast("bigint") * (width + 1) ** i for i, j in enumerate(blocks))

    groups, base = [group(g) for g in range(GROUPS)], (width + 1) ** per
    pairs = [(a, b) for a in range(GROUPS) for b in range(a)]
    return F.array(*[(groups[a] * base + groups[b]) * len(pairs) + i for i, (a, b) in enumerate(pairs)])


def links(prints: DataFrame) -> DataFrame:
    """a > b: pairs of distinct fingerprints that connect all within RADIUS bits; prints: fp, distinct."""
    tabled = prints.select("fp", distance_table(F.col("fp")).alias("table"))
    keyed = tabled.select("fp", "table", F.explode(bucket_keys(F.col("table"))).alias("key"))
    shared = keyed.select("key").groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    met = cut(keyed.join(shared, "key"), "buckets")
    few = met.filter(F.col("n") <= LARGE)
    a, b = few.alias("a"), few.alias("b")
    apart = F.array_max(F.zip_with("a.table", "b.table", lambda x, y: F.abs(x - y)))
    pairs = (
        a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") > F.col("b.fp")))
        .filter(apart <= RADIUS)
        .filter(F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= RADIUS)
        .select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))
    )
    many = met.filter(F.col("n") > LARGE).select("fp").distinct()
    bits = F.array(F.lit(0).cast("bigint"), *[F.lit(_signed(1 << i)).cast("bigint") for i in range(64)])
    near = many.select("fp", F.explode(F.transform(bits, lambda x: F.col("fp").bitwiseXOR(x))).alias("point"))
    hubs = near.groupBy("point").agg(F.min("fp").alias("hub"), F.count("*").alias("n")).filter("n > 1")
    stars = near.join(hubs, "point").filter(F.col("fp") > F.col("hub")).select(F.col("fp").alias("a"), F.col("hub").alias("b"))
    return pairs.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, row_key, root, component_id for each row of docs; root: the component's smallest fingerprint."""
    slim = cut(fingerprints(docs, id_col, text_col), "fingerprints")
    prints = cut(slim.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    roots = components(links(prints.select("fp")))
    rooted = prints.join(roots, prints.fp == roots.node, "left").select("fp", "first_id", F.coalesce("component", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    ids = rooted.join(named, "root").select("fp", "root", "component_id")
    return slim.join(ids, "fp").select("doc_id", "fp", "row_key", "root", "component_id")


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component: that of the smallest id, of several with it the one of the least row key, a hash
    of all columns; rows without an id come last. Rows that are equal in all columns count once.

    Texts are shuffled once, to their row keys; keys that repeat are few and are looked up by a second scan.
    """
    found = near_duplicates(docs, id_col, text_col)
    rows = found.groupBy("root", "doc_id", "row_key").agg(F.count("*").alias("n"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_key", "n")).alias("k")
    kept = cut(rows.groupBy("root").agg(first).select(F.col("k.doc_id").alias("kept_id"), F.col("k.row_key").alias("kept_key"), "k.n"), "kept")
    keyed = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("bigint").alias("id"), row_hash(docs).alias("row_key"))
    on = (F.col("row_key") == F.col("kept_key")) & F.col("id").eqNullSafe(F.col("kept_id"))
    single = keyed.join(kept.filter("n = 1"), on, "left_semi").select("row.*")
    repeats = cut(kept.filter("n > 1"), "repeats")
    if repeats.isEmpty():
        return single
    equal = keyed.join(repeats, on, "left_semi").groupBy("row_key", "id").agg(F.first("row").alias("row"))
    return single.unionByName(equal.select("row.*"))
