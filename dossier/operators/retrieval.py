"""Filtered hybrid retrieval: vector top-k, text bonus, ancestry, reranking, grouping and the answer's envelope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.cuts import cut
from dossier.functions import vectors

VECTOR_SHARE, TEXT_SHARE = 0.7, 0.3
LEAST_CANDIDATES = 60


def contains_all(column: Column, wanted: list) -> Column:
    """Containment: every wanted value is in the array (true for none wanted)."""
    return F.size(F.array_except(F.array(*map(F.lit, wanted)), column)) == 0 if wanted else F.lit(True)


def contains_any(column: Column, wanted: list | None) -> Column:
    """Any wanted value is in the array; no filter where wanted is None."""
    return F.lit(True) if wanted is None else F.arrays_overlap(column, F.array(*map(F.lit, wanted))) if wanted else F.lit(False)


def tokens(text: Column) -> Column:
    """Lowercase words, the default analyser of full-text predicates."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def matches_text(text: Column, query: str) -> Column:
    """All words of the query are words of the text; false for a query without words."""
    words = sorted(set("".join(c if c.isalnum() and c.isascii() else " " for c in query.lower()).split()))
    return contains_all(tokens(text), words) if words else F.lit(False)


def text_score(text: Column, query: str) -> Column:
    """Share of a text's words that the query names, at most 1: a documented stand-in for a rank function."""
    words = sorted(set(query.lower().split()))
    hits = F.size(F.filter(tokens(text), lambda t: t.isin(words)))
    return F.least(F.lit(1.0), F.coalesce(F.try_divide(hits.cast("double"), F.size(tokens(text))), F.lit(0.0)))


def candidates(chunks: DataFrame, query: Column, threshold: float, count: int, where: Column | None = None, key: str = "chunk_id") -> DataFrame:
    """The nearest chunks above the threshold, GREATEST(3 * count, 60) of them, before anything is joined.

    Ties go to the smaller key. One pass and a bounded top-k per task; the vector column is dropped.
    """
    scored = chunks.filter(F.col("embedding").isNotNull() & (where if where is not None else F.lit(True))).withColumn("cosine", vectors.cosine(F.col("embedding"), query)).drop("embedding")
    return scored.filter(F.col("cosine") > threshold).orderBy(F.desc("cosine"), key).limit(max(3 * count, LEAST_CANDIDATES))


def match_chunks(
    chunks: DataFrame, documents: DataFrame, query: Column | None, threshold: float = 0.7, count: int = 10, topic_ids: list | None = None, other: dict[str, list] | None = None, text: str | None = None, inherited: tuple[str, ...] = (), ranks: DataFrame | None = None, found: bool = False
) -> DataFrame:
    """Hybrid search. chunks: chunk_id, document_id, content, embedding and metadata arrays; documents: id, root_id and more.

    Topics filter by any, other arrays by all of their values. The text bonus applies to candidates only. `inherited`
    columns come from the document, or else from its root. `ranks` (chunk_id, rank), the matches of a stored full-text index, takes the
    place of `text`, which is matched word by word. With found=True chunks are the candidates that a stored index has given, with
    their cosine; no vector is compared and no filter applied again.
    """
    where = contains_any(F.col("topic_ids"), topic_ids) if topic_ids is not None else F.lit(True)
    for column, wanted in (other or {}).items():
        where = where & contains_all(F.col(column), wanted)
    near = chunks if found else candidates(chunks, query, threshold, count, where)
    bonus = F.when(matches_text(F.col("content"), text or ""), VECTOR_SHARE * F.col("cosine") + TEXT_SHARE * text_score(F.col("content"), text or "")).otherwise(F.col("cosine"))
    if ranks is not None:
        near = near.join(ranks.select("chunk_id", "rank"), "chunk_id", "left")
        bonus = F.when(F.col("rank").isNotNull(), VECTOR_SHARE * F.col("cosine") + TEXT_SHARE * F.col("rank")).otherwise(F.col("cosine"))
    near = near.withColumn("similarity", bonus if text or ranks is not None else F.col("cosine")).drop("cosine", "rank")
    d, r = documents.alias("d"), documents.alias("r")
    joined = near.alias("c").join(d, F.col("c.document_id") == F.col("d.id")).join(r, F.col("d.root_id") == F.col("r.id"), "left")
    return (
        joined.select("c.*", F.col("d.id").alias("document_uuid"), F.col("r.id").alias("root_uuid"), *[F.coalesce(F.col(f"d.{c}"), F.col(f"r.{c}")).alias(c) for c in inherited])
        .orderBy(F.desc("similarity"), "chunk_id").limit(count)
    )


def similar_topics(topics: DataFrame, query: Column, threshold: float = 0.85, count: int = 5, exclude: list | None = None) -> DataFrame:
    """Topics above the threshold among GREATEST(4 * count, 20) nearest: id, name, similarity."""
    usable = topics.filter(F.col("embedding").isNotNull() & (~F.col("id").isin(exclude) if exclude else F.lit(True)))
    near = usable.select("id", "name", vectors.cosine(F.col("embedding"), query).alias("similarity")).orderBy(F.desc("similarity"), "id").limit(max(4 * count, 20))
    return near.filter(F.col("similarity") > threshold).orderBy(F.desc("similarity"), "id").limit(count)


def rerank(hits: DataFrame, score: Column, count: int, floor: float = 0.0, by: list[str] | None = None, key: str = "chunk_id") -> DataFrame:
    """Best `count` by a pluggable score with rerank_score >= floor; the best one stays whatever its score."""
    order = [F.desc("rerank_score"), F.col(key)]
    ranked = hits.withColumn("rerank_score", score)
    if by is None:
        ranked = ranked.orderBy(*order).limit(count)
    place = F.row_number().over((Window.partitionBy(*by) if by else Window.partitionBy()).orderBy(*order))
    return ranked.withColumn("rank", place).filter((F.col("rank") <= count) & ((F.col("rerank_score") >= floor) | (F.col("rank") == 1)))


def fall_back(filtered: DataFrame, unfiltered: DataFrame, wanted: int) -> DataFrame:
    """The filtered hits, or the unfiltered ones where those are fewer than max(1, wanted // 4). One bounded count."""
    enough = filtered.limit(wanted).count() >= max(1, wanted // 4)
    return (filtered if enough else unfiltered).withColumn("topic_filter_used", F.lit(enough))


def by_incident(hits: DataFrame, keys: list[str], rank: str = "rank", subject: str = "subject") -> DataFrame:
    """Hits grouped by the first key that is set, in order of first appearance, with their number and first subject."""
    incident = F.coalesce(*[F.when(F.col(k).cast("string") != "", F.col(k).cast("string")) for k in keys], F.lit("unknown"))
    return (
        hits.groupBy(incident.alias("incident")).agg(F.count("*").alias("hits"), F.min(rank).alias("first_rank"), F.min_by(subject, rank).alias("subject")).orderBy("first_rank", "incident")
    )


def context_block(title: Column, subject: Column, chunk: Column, text: Column, summary: Column) -> Column:
    """The citation header and text of one hit, as a language model sees it."""
    short = lambda c, n: F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).when(c != "", c)
    named = lambda label, c: F.concat(F.lit(f'{label}:"'), c, F.lit('"'))
    header = F.concat(F.lit("["), F.concat_ws(" | ", F.concat(F.lit("CITE:"), chunk), named("title", short(title, 50)), named("subject", short(subject, 40))), F.lit("]"))
    body = F.when(summary != "", F.concat(F.lit("[Context: "), summary, F.lit("]\n"), text)).otherwise(text)
    return F.concat(header, F.lit("\n"), body)


def envelope(hits: DataFrame, block: Column, rank: str = "rank", key: str = "chunk_id") -> DataFrame:
    """One row: the context of all hits in order, their ids and number. For a bounded result of a search."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), F.col(key).alias("k"), block.alias("b"))))
    return hits.agg(ordered.alias("x")).select(
        F.array_join(F.transform("x", lambda s: s["b"]), "\n\n---\n\n").alias("context"), F.transform("x", lambda s: s["k"]).alias("ids"), F.size("x").alias("count")
    )


def hashed_embedding(text: Column, dimensions: int = 64) -> Column:
    """The default embedding: counts of a text's different words by hash, with signs, of unit length; natively."""
    words = F.array_distinct(tokens(text))
    slots = F.transform(words, lambda w: F.struct(F.pmod(F.xxhash64(w), F.lit(dimensions)).alias("i"), F.when(F.pmod(F.crc32(w), F.lit(2)) == 0, 1.0).otherwise(-1.0).alias("s")))
    zeros = F.array_repeat(F.lit(0.0), dimensions)
    add = lambda acc, x: F.transform(acc, lambda v, i: F.when(i == x["i"], v + x["s"]).otherwise(v))
    length = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    # arrays of one element bind a value that is used many times
    bound = F.transform(F.array(F.aggregate(slots, zeros, add)), lambda v: F.struct(v.alias("v"), length(v).alias("n")))
    return F.transform(bound, lambda b: F.transform(b["v"], lambda x: F.when(b["n"] > 0, x / b["n"]).otherwise(0.0)))[0]


def retrieve(chunks: DataFrame, query: Column, count: int = 20, threshold: float = 0.3, rerank_count: int = 5, score: Column | None = None, floor: float = 0.0) -> DataFrame:
    """Two stages: the nearest chunks, then the best of them by a pluggable score (default: the cosine)."""
    found = candidates(chunks, query, threshold, count).orderBy(F.desc("cosine"), "chunk_id").limit(count)
    return rerank(found, score if score is not None else F.col("cosine"), rerank_count, floor)


def topic_filter(chunks: DataFrame, topics: DataFrame, query: Column, threshold: float = 0.55, looser: float = 0.45, count: int = 5, other: Column | None = None) -> DataFrame:
    """One row: the topics to filter by (those above the threshold, else above a looser one), how many chunks they leave,
    and the decision: skip where no topic matches or no chunk is left."""
    near = similar_topics(topics, query, looser, count)
    tight = near.filter(F.col("similarity") > threshold)
    chosen = near.agg(F.collect_list(F.when(F.col("similarity") > threshold, F.col("id"))).alias("tight"), F.collect_list("id").alias("loose"))
    chosen = chosen.select(F.when(F.size("tight") > 0, F.col("tight")).otherwise(F.col("loose")).alias("topic_ids"), (F.size("tight") == 0).alias("loosened"))
    rows = chunks.filter(other) if other is not None else chunks
    ids = tight.select("id").unionByName(near.join(tight.agg(F.count("*").alias("n")).filter("n = 0"), F.lit(True)).select("id"))
    left = rows.select("chunk_id", F.explode("topic_ids").alias("id")).join(ids, "id", "left_semi").agg(F.count_distinct("chunk_id").alias("chunks"))
    decision = F.when(F.size("topic_ids") == 0, "skip_no_topic").when(F.col("chunks") == 0, "skip_no_chunk").otherwise("filter")
    return chosen.join(left, F.lit(True)).withColumn("decision", decision)


def topic_names_filter(names: DataFrame, topics: DataFrame, query: Column, threshold: float = 0.55, looser: float = 0.45, count: int = 5, least_chunks: int = 1, suggestions: int = 3) -> DataFrame:
    """One row: what the topics named in a question filter by: detected, topic_ids, unmatched, chunks, loosened, decision and
    suggested.

    names: name, embedding of each detected name; topics: id, name, embedding, chunk_count. Each name matches a cluster of its
    `count` most similar topics above the threshold, one of the very name first; the clusters are pooled. Where the pool has
    under least_chunks chunks, a looser threshold is tried and kept if it finds more. No name: search broadly; no topic, or
    topics without chunks: skip, and in the latter case suggest related topics with chunks.
    """
    named = names.select(F.col("name").alias("asked"), F.col("embedding").alias("e"))
    same = (F.lower(F.trim("asked")) == F.lower(F.trim("name"))).cast("int")
    # every detected name of one question, a handful of rows, meets every topic
    near = named.join(topics.filter("embedding is not null"), F.lit(True))
    near = near.select("asked", "id", "name", "chunk_count", same.alias("same"), vectors.cosine(F.col("embedding"), F.col("e")).alias("similarity"))
    place = F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("same"), F.desc("similarity"), "id"))
    clusters = cut(near.filter((F.col("similarity") > looser) | (F.col("same") == 1)).withColumn("place", place).filter(F.col("place") <= count), "clusters")

    def pool(rows: DataFrame, name: str) -> DataFrame:
        ids = rows.groupBy("id").agg(F.max("chunk_count").alias("chunk_count"))
        found = rows.agg(F.collect_set("asked").alias("asked"))
        totals = ids.agg(F.array_sort(F.collect_list("id")).alias("ids"), F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("chunks"))
        return totals.join(found, F.lit(True)).select(F.struct("ids", "chunks", "asked").alias(name))

    tight = pool(clusters.filter((F.col("similarity") > threshold) | (F.col("same") == 1)), "tight")
    detected = named.agg(F.array_sort(F.collect_set("asked")).alias("detected"))
    both = detected.join(tight, F.lit(True)).join(pool(clusters, "loose"), F.lit(True))
    loosened = (F.col("tight.chunks") < least_chunks) & (F.col("loose.chunks") > F.col("tight.chunks"))
    used = both.select("detected", loosened.alias("loosened"), F.when(loosened, F.col("loose")).otherwise(F.col("tight")).alias("used"))
    related = similar_topics(topics.filter("chunk_count > 0"), query, -1.0, suggestions).agg(F.collect_list(F.struct((-F.col("similarity")).alias("far"), "name")).alias("related"))
    decision = (
        F.when(F.size("detected") == 0, "broad").when(F.size("used.ids") == 0, "skip_no_topic").when(F.col("used.chunks") == 0, "skip_no_chunk").otherwise("filter")
    )
    out = used.join(related, F.lit(True)).withColumn("decision", decision)
    none = F.array().cast("array<string>")
    suggested = F.when(F.col("decision") == "skip_no_chunk", F.transform(F.array_sort("related"), lambda r: r["name"])).otherwise(none)
    return out.select("detected", F.col("used.ids").alias("topic_ids"), F.array_sort(F.array_except("detected", "used.asked")).alias("unmatched"), F.col("used.chunks").alias("chunks"), "loosened", "decision", suggested.alias("suggested"))


def incident_summary(incidents: DataFrame) -> DataFrame:
    """One row: `summary`, the text on the incidents that hits fall into; incidents: as by_incident() gives them, with date.

    For the bounded result of a search.
    """
    filled = lambda c, none: F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit(none))
    row = F.struct("first_rank", "incident", filled("subject", "Unknown Subject").alias("subject"), filled("date", "Unknown Date").alias("date"), "hits")
    rows = incidents.agg(F.array_sort(F.collect_list(row)).alias("rows"), F.coalesce(F.sum("hits"), F.lit(0)).alias("total"))
    head = F.concat(
        F.lit("\n---\n\n## Incident Summary\nFound "), F.col("total").cast("string"), F.lit(" relevant chunks from "), F.size("rows").cast("string"), F.lit(" unique incident(s).\n"),
    )
    part = lambda r, i: F.concat(F.lit("\n**Incident "), (i + 1).cast("string"), F.lit(":** "), r["subject"], F.lit("\n  - Date: "), r["date"], F.lit("\n  - Relevant sections: "), r["hits"].cast("string"), F.lit("\n"))
    return rows.select(F.concat(head, F.array_join(F.transform("rows", part), "")).alias("summary"))
