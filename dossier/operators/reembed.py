"""Embedding a library again after its rules or texts have changed: only what changed is chunked again, and topics stay.

A document is compared by the digest of its text and by its mode. Chunks of unchanged documents pass through as they are, with
their ids and vectors; those of changed ones are made anew and take over the topics that their document's old chunks had.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.cuts import cut
from dossier.sources import files

KEEP, REBUILD, NEW, DROP = "keep", "rebuild", "new", "drop"


def decisions(documents: DataFrame, stored: DataFrame, force: bool = False) -> DataFrame:
    """doc_id, action, reason and text_digest of every document, present or stored.

    documents: doc_id, text, embedding_mode (as decided now); stored: doc_id, text_digest, embedding_mode (as embedded). With force
    unchanged documents are embedded again too.
    """
    now = documents.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_digest"), "embedding_mode", F.lit(True).alias("here"))
    then = stored.select("doc_id", F.col("text_digest").alias("old_digest"), F.col("embedding_mode").alias("old_mode"), F.lit(True).alias("there"))
    both = now.join(then, "doc_id", "full")
    text, mode = (~F.col(a).eqNullSafe(F.col(b)) for a, b in (("text_digest", "old_digest"), ("embedding_mode", "old_mode")))
    reason = F.when(F.col("here").isNull(), "gone").when(F.col("there").isNull(), "new").when(text & mode, "text and mode").when(text, "text").when(mode, "mode").when(F.lit(force), "forced")
    action = F.when(F.col("here").isNull(), DROP).when(F.col("there").isNull(), NEW).when(reason.isNotNull(), REBUILD).otherwise(KEEP)
    return both.select("doc_id", action.alias("action"), reason.alias("reason"), "text_digest", "embedding_mode")


def reembedded(documents: DataFrame, chunks: DataFrame, decided: DataFrame, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The new chunks: those of kept documents, and for rebuilt and new ones what make(documents) gives, with their topics.

    chunks and make's rows: document_id and more; topic_ids of the first, an array, is carried over as the document's set.
    """
    action = decided.select(F.col("doc_id").alias("document_id"), "action")
    kept = chunks.join(action.filter(F.col("action") == KEEP), "document_id", "left_semi")
    stale = action.filter(F.col("action") == REBUILD)
    topics = chunks.join(stale, "document_id", "left_semi").select("document_id", F.explode("topic_ids").alias("topic"))
    topics = topics.distinct().groupBy("document_id").agg(F.array_sort(F.collect_list("topic")).alias("topic_ids"))
    again = documents.join(decided.filter(F.col("action").isin(REBUILD, NEW)).select("doc_id"), "doc_id", "left_semi")
    made = make(again).join(topics, "document_id", "left")
    none = F.array().cast(chunks.schema["topic_ids"].dataType)
    return kept.unionByName(made.withColumn("topic_ids", F.coalesce("topic_ids", none)), allowMissingColumns=True)


def changes(old: DataFrame, new: DataFrame, decided: DataFrame) -> DataFrame:
    """doc_id, action, reason, dropped, made and kept: chunks of each document."""
    n = lambda df, name: df.groupBy(F.col("document_id").alias("doc_id")).agg(F.count(F.lit(1)).alias(name))
    counted = decided.select("doc_id", "action", "reason").join(n(old, "before"), "doc_id", "left").join(n(new, "after"), "doc_id", "left").fillna(0, ["before", "after"])
    stays = F.col("action") == KEEP
    return counted.select("doc_id", "action", "reason", F.when(stays, 0).otherwise(F.col("before")).alias("dropped"), F.when(stays, 0).otherwise(F.col("after")).alias("made"), F.when(stays, F.col("after")).otherwise(0).alias("kept"))


def lines_missing(chunks: DataFrame) -> DataFrame:
    """document_id of documents that have a chunk without line numbers: they are indexed again."""
    return chunks.filter(F.col("line_from").isNull() | F.col("line_to").isNull()).select("document_id").distinct()


def with_lines(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """chunks with line_from and line_to, from 1, where they lack them and their content is found in their document's text.

    chunks: document_id, char_start (null if unknown), content. Only the texts of documents with such chunks are read on.
    """
    texts = documents.join(lines_missing(chunks).withColumnRenamed("document_id", "doc_id"), "doc_id", "left_semi").select(F.col("doc_id").alias("document_id"), F.coalesce("text", F.lit("")).alias("_text"))
    at = F.coalesce(F.col("char_start").cast("int"), F.instr(F.col("_text"), F.col("content")) - 1)
    breaks = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    first = breaks(F.left("_text", F.col("_at"))) + 1
    found = chunks.join(texts, "document_id", "left").withColumn("_at", at)
    known = (F.col("_at") >= 0) & F.col("line_from").isNull() & F.col("_text").isNotNull()
    return found.withColumns({"line_from": F.when(known, first).otherwise(F.col("line_from")), "line_to": F.when(known, first + breaks(F.rtrim("content", F.lit("\n")))).otherwise(F.col("line_to"))}).drop("_text", "_at")


def run(spark: SparkSession, path: str, documents: DataFrame, make: Callable[[DataFrame], DataFrame], force: bool = False) -> DataFrame:
    """Re-embeds the versioned library at path (tables documents and chunks) and puts the new version in place in one step; its changes."""
    stored, chunks = (files.read_atomic(spark, path, name) for name in ("documents", "chunks"))
    decided = cut(decisions(documents, stored, force), "decided")
    new = cut(reembedded(documents, chunks, decided, make), "chunks")
    report = cut(changes(chunks, new, decided), "changes")
    kept = documents.drop("text_digest", "embedding_mode").join(decided.filter(F.col("action") != DROP).select("doc_id", "text_digest", "embedding_mode"), "doc_id")
    files.write_atomic({"documents": kept, "chunks": new}, path)
    return report
