"""Consolidating topics: similar pairs, clusters, greedy and by-name merge plans, get-or-create."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.cuts import cut
from dossier.functions.text import normal_name
from dossier.operators import similar
from dossier.operators.components import components

FIRST_ROUNDS = 6  # of a greedy plan, before its components are told apart


def similar_pairs(topics: DataFrame, least: float, below: float | None = None, key: str = "id") -> DataFrame:
    """a < b and similarity of all pairs with similarity in [least, below)."""
    return similar.self_join(topics, least, below, key).pairs()


def similar_links(topics: DataFrame, least: float, key: str = "id") -> DataFrame:
    """(a, b) that connect what pairs of similarity >= least connect; copies of a vector are linked to one of them only."""
    found = similar.self_join(topics, least, None, key)
    return found.links().select("a", "b").unionByName(found.copies().select(F.col("rep").alias("a"), F.col("id").alias("b")))


def _heaviest(weight: str, key: str) -> Column:
    """The heaviest row's key (ties: the smaller key), as an aggregate that combines before the shuffle."""
    return F.min(F.struct((-F.col(weight)).alias("w"), F.col(key).alias("k")))["k"]


def cluster_plan(topics: DataFrame, pairs: DataFrame, weight: str = "chunk_count", key: str = "id") -> DataFrame:
    """absorbed, keeper: single-linkage clusters merge into their heaviest member (ties: the smaller id)."""
    label = components(pairs.select("a", "b"))
    member = topics.join(label, topics[key] == label.node).select(F.col(key).alias("id"), weight, "component")
    keepers = member.groupBy("component").agg(_heaviest(weight, "id").alias("keeper"))
    return member.join(keepers, "component").filter(F.col("id") != F.col("keeper")).select(F.col("id").alias("absorbed"), "keeper")


def _sequential(group: pd.DataFrame) -> pd.DataFrame:
    """The topics of one component that are absorbed, heaviest first; group: over, under, w, wu."""
    weight = dict(zip(group["over"], group["w"], strict=True)) | dict(zip(group["under"], group["wu"], strict=True))
    under: dict = {}
    for o, u in zip(group["over"], group["under"], strict=True):
        under.setdefault(o, []).append(u)
    absorbed: set = set()
    for topic in sorted(weight, key=lambda t: (-weight[t], t)):
        if topic not in absorbed:
            absorbed.update(under.get(topic, ()))
    return pd.DataFrame({"under": list(absorbed)})


def _by_rounds(left: DataFrame, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Absorbed topics (under), by set operations, so that no task sees a component; and the edges left after `most` rounds.

    In each round, topics without a heavier undecided neighbour keep and their undecided neighbours are absorbed, until none
    is undecided.
    """
    absorbed, rounds = left.select("under").limit(0), 0
    while rounds != most and not left.isEmpty():
        keep = left.select("over").distinct().join(left.select(F.col("under").alias("over")).distinct(), "over", "left_anti")
        keep, rounds = cut(keep, "keep"), rounds + 1
        hit = cut(left.join(keep, "over", "left_semi").select("under").distinct(), "hit")
        absorbed = absorbed.unionByName(hit)
        if rounds % 16 == 0:
            absorbed = cut(absorbed, "absorbed")
        gone = keep.unionByName(hit.select(F.col("under").alias("over")))
        left = cut(left.join(gone, "over", "left_anti").join(hit, "under", "left_anti").select("over", "under", "w", "wu"), "left")
    return absorbed, left


def greedy_plan(topics: DataFrame, pairs: DataFrame, weight: str = "chunk_count", key: str = "id", most_edges: int = 100_000) -> DataFrame:
    """absorbed, keeper: heaviest first (ties: the smaller id), each topic absorbs its similar lighter ones that are still
    free; not transitive.

    A few rounds of set operations decide all topics but those at the end of long chains. Connected components of the rest are
    decided apart: one of up to most_edges pairs is walked through in a task; larger ones take further rounds, with the same
    result. Each absorbed topic then goes to the heaviest keeper beside it.
    """
    place = cut(topics.select(F.col(key).alias("id"), F.col(weight).alias("w")), "weights")
    edge = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b")
    edge = edge.join(place.select(F.col("id").alias("a"), F.col("w").alias("wa")), "a").join(place.select(F.col("id").alias("b"), F.col("w").alias("wb")), "b")
    first = lambda a, b: F.when(F.col("wa") >= F.col("wb"), F.col(a)).otherwise(F.col(b))  # noqa: E731  # a is the smaller id
    edges = cut(edge.filter("wa is not null and wb is not null").select(first("a", "b").alias("over"), first("b", "a").alias("under"), first("wa", "wb").alias("w"), first("wb", "wa").alias("wu")), "over")
    absorbed, left = _by_rounds(edges, FIRST_ROUNDS)
    if not left.isEmpty():
        label = components(left.select(F.col("over").alias("a"), F.col("under").alias("b")))
        labelled = cut(left.join(label.select(F.col("node").alias("over"), "component"), "over"), "labelled")
        sizes = labelled.groupBy("component").agg(F.count("*").alias("edges"))
        small = labelled.join(sizes.filter(F.col("edges") <= most_edges), "component")
        walked = small.groupBy("component").applyInPandas(_sequential, f"under {edges.schema['under'].dataType.simpleString()}")
        large = labelled.join(sizes.filter(F.col("edges") > most_edges), "component").select("over", "under", "w", "wu")
        absorbed = absorbed.unionByName(walked).unionByName(_by_rounds(large)[0])
    keepers = cut(edges.select("over").distinct().join(cut(absorbed, "absorbed").withColumnRenamed("under", "over"), "over", "left_anti"), "keepers")
    beside = edges.join(keepers, "over", "left_semi").groupBy("under").agg(F.min(F.struct((-F.col("w")).alias("w"), F.col("over").alias("k"))).alias("best"))
    return beside.select(F.col("under").alias("absorbed"), F.col("best.k").alias("keeper"))


def name_plan(topics: DataFrame, name: str = "name", weight: str = "chunk_count", key: str = "id") -> DataFrame:
    """absorbed, keeper: topics of one normalised name merge into the heaviest."""
    named = topics.withColumn("_bucket", normal_name(F.col(name))).filter("_bucket <> ''").select(key, weight, "_bucket")
    named = named.join(named.groupBy("_bucket").agg(_heaviest(weight, key).alias("keeper")), "_bucket")
    return named.filter(F.col(key) != F.col("keeper")).select(F.col(key).alias("absorbed"), "keeper")


def resolve(names: DataFrame, topics: DataFrame, least: float) -> DataFrame:
    """name, topic_id, how (name, similar or new): known names first, then the most similar topic, else a new id.

    names: name, embedding; topics: id, name, embedding. Equal normalised names resolve alike.
    """
    wanted = names.withColumn("bucket", normal_name(F.col("name")))
    known = topics.withColumn("bucket", normal_name(F.col("name"))).groupBy("bucket").agg(F.min("id").alias("known_id"))
    by_name = wanted.join(known, "bucket", "left")
    misses = by_name.filter("known_id is null").groupBy("bucket").agg(F.min_by("embedding", "name").alias("embedding"))
    asked = cut(misses.filter(F.col("embedding").isNotNull()), "misses")
    near = similar.join(asked, topics, least, "bucket", "id").nearest()
    best = near.groupBy(F.col("a").alias("bucket")).agg(F.max_by(F.col("b"), F.struct("similarity", -F.xxhash64("b"))).alias("similar_id"))
    new = F.substring(F.sha2(F.concat(F.lit("topic:"), F.col("bucket")), 256), 1, 32)
    how = F.when(F.col("known_id").isNotNull(), "name").when(F.col("similar_id").isNotNull(), "similar").otherwise("new")
    return by_name.join(best, "bucket", "left").select("name", F.coalesce(F.col("known_id").cast("string"), F.col("similar_id"), new).alias("topic_id"), how.alias("how"))


def recount(topics: DataFrame, bridge: DataFrame, chunks: DataFrame, drop_empty: bool = True) -> DataFrame:
    """topics with chunk_count and document_count from the bridge; those without chunks dropped."""
    counts = bridge.join(chunks.select("chunk_id", "document_id"), "chunk_id").groupBy(F.col("topic_id").alias("id")).agg(F.count_distinct("chunk_id").alias("chunk_count"), F.count_distinct("document_id").alias("document_count"))
    out = topics.drop("chunk_count", "document_count").join(counts, "id", "inner" if drop_empty else "left")
    return out if drop_empty else out.fillna(0, ["chunk_count", "document_count"])


def filter_scope(chosen: Column) -> Column:
    """What a topic filter does with the matched topics: skip, one or any."""
    return F.when(F.size(chosen) == 0, "skip").when(F.size(chosen) == 1, "one").otherwise("any")
