"""Changes to tables as pure functions from frames to new frames; a writer or foreachBatch stores the result."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).filter("_place = 1").drop("_place")


def upsert(base: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """base with rows of changes in place of those with equal keys; new keys are added. Keys of changes are unique."""
    return base.join(changes.select(*keys), keys, "left_anti").unionByName(changes, allowMissingColumns=True)


def insert_ignore(base: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """base with rows whose keys it lacks; of rows with equal keys one."""
    return base.unionByName(rows.dropDuplicates(keys).join(base.select(*keys), keys, "left_anti"))


def cascade_delete(tables: dict[str, tuple[DataFrame, str]], roots: DataFrame, key: str) -> dict[str, DataFrame]:
    """Each table (frame, its column that holds a root id) without the rows of the given roots."""
    return {name: df.join(roots.select(F.col(key).alias(column)), column, "left_anti") for name, (df, column) in tables.items()}


def replace_groups(base: DataFrame, rows: DataFrame, group: str, groups: DataFrame | None = None) -> DataFrame:
    """base with all rows of each group in rows (and of `groups`) replaced by those in rows."""
    touched = rows.select(group).distinct() if groups is None else groups.select(group).unionByName(rows.select(group)).distinct()
    return base.join(touched, group, "left_anti").unionByName(rows)


def rewrite_ids(df: DataFrame, mapping: DataFrame, column: str, key: str, old: str = "old", new: str = "new") -> tuple[DataFrame, DataFrame]:
    """df with ids of an array column rewritten, different and sorted, and a one-row frame with the number of rows changed.

    Only rows with an id in the mapping change. The mapping is joined, not broadcast by hand, as its size is unknown.
    """
    ids = df.select(key, F.explode(column).alias(old))
    hit = ids.join(mapping, old).select(key).distinct()
    rewritten = (
        ids.join(hit, key, "left_semi").join(mapping, old, "left").groupBy(key).agg(F.array_sort(F.collect_set(F.coalesce(F.col(new), F.col(old)))).alias("_ids"))
    )
    out = df.join(rewritten, key, "left").withColumn(column, F.coalesce("_ids", column)).drop("_ids")
    return out, rewritten.agg(F.count("*").alias("updated"))


def apply_counters(base: DataFrame, deltas: DataFrame, key: str, counter: str, delta: str) -> DataFrame:
    total = deltas.groupBy(key).agg(F.sum(delta).alias("_delta"))
    return base.join(total, key, "left").withColumn(counter, F.col(counter) + F.coalesce("_delta", F.lit(0))).drop("_delta")


def reset_stale(log: DataFrame, now: Column, minutes: int) -> DataFrame:
    """Rows that have been PROCESSING for over `minutes`, or without a start, become FAILED."""
    started = F.col("started_at")
    stale = (F.col("status") == "PROCESSING") & (started.isNull() | (started < now - F.make_interval(mins=F.lit(minutes))))
    return log.withColumns({"error": F.when(stale, F.lit("stale")).otherwise(F.col("error")), "status": F.when(stale, F.lit("FAILED")).otherwise(F.col("status"))})


def coalesce_update(base: DataFrame, changes: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """base with the non-null values of changes; rows of changes without a match are ignored."""
    renamed = changes.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns])
    out = base.join(renamed, keys, "left")
    return out.withColumns({c: F.coalesce(f"_{c}", c) for c in columns}).select(*base.columns)


def partial_update(base: DataFrame, changes: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """changes holds, per column, struct(provided, value): provided values replace, also by null; others stay."""
    renamed = changes.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns])
    out = base.join(renamed, keys, "left")
    return out.withColumns({c: F.when(F.col(f"_{c}.provided"), F.col(f"_{c}.value")).otherwise(F.col(c)) for c in columns}).select(*base.columns)


def prune(base: DataFrame, keep: DataFrame, keys: list[str]) -> DataFrame:
    return base.join(keep.select(*keys).distinct(), keys, "left_semi")


def repoint_suffix(uri: Column, suffix: Column, new: Column) -> Column:
    return F.when(F.endswith(uri, suffix), F.concat(F.substring(uri, F.lit(1), F.length(uri) - F.length(suffix)), new)).otherwise(uri)


def retagged(df: DataFrame, ids: Column, types: Column, classes: Column) -> DataFrame:
    """New entity ids on rows (none: the ids go); types and classes only where the new lists hold any."""
    return df.withColumns(
        {
            "entity_ids": F.when(F.size(ids) > 0, ids),
            "entity_types": F.when(F.size(types) > 0, types).otherwise(F.col("entity_types")),
            "entity_classes": F.when(F.size(classes) > 0, classes).otherwise(F.col("entity_classes")),
        }
    )


def apply_merges(bridge: DataFrame, merges: DataFrame, topic: str = "topic_id", owner: str = "chunk_id") -> DataFrame:
    """Memberships moved from absorbed to keeping topics (merges: absorbed, keeper), each once."""
    moved = bridge.join(merges.select(F.col("absorbed").alias(topic), "keeper"), topic, "left")
    return moved.select(owner, F.coalesce("keeper", topic).alias(topic)).distinct()


def backfill(bridge: DataFrame, children: DataFrame, chunks: DataFrame) -> DataFrame:
    """Bridge rows that attachments lack: every topic of the root's chunks for every chunk of its children.

    children: document_id, root_id; chunks: chunk_id, document_id; bridge: chunk_id, topic_id.
    """
    root_topics = bridge.join(chunks, "chunk_id").select(F.col("document_id").alias("root_id"), "topic_id").distinct()
    wanted = children.join(root_topics, "root_id").join(chunks, "document_id").select("chunk_id", "topic_id").distinct()
    return wanted.join(bridge, ["chunk_id", "topic_id"], "left_anti")


def stamped(changed: DataFrame, base: DataFrame, keys: list[str], now: Column, column: str = "updated_at") -> DataFrame:
    """changed with `column` set to now where a row is new or differs from the row of its key in base, else as base has it."""
    values = [c for c in changed.columns if c not in (*keys, column)]
    old = base.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[F.col(c).alias(f"_o_{c}") for c in values], F.col(column).alias("_stamp"), F.lit(True).alias("_known"))
    on = functools.reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    same = functools.reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_o_{c}")) for c in values], F.col("_known").isNotNull())
    return changed.drop(column).join(old, on, "left").select(*[c for c in changed.columns if c != column], F.when(same, F.col("_stamp")).otherwise(now).alias(column))


def mark_checked(chunks: DataFrame, documents: DataFrame, document: str = "document_id", flag: str = "topics_checked") -> DataFrame:
    """chunks with the flag set for all chunks of the given documents; those of others keep theirs."""
    done = documents.select(F.col(document)).distinct().withColumn("_done", F.lit(True))
    held = F.coalesce(F.col(flag), F.lit(False)) if flag in chunks.columns else F.lit(False)
    return chunks.join(done, document, "left").withColumn(flag, F.coalesce("_done", held)).drop("_done")


def with_fresh_ids(documents: DataFrame, chunks: DataFrame, existing: DataFrame, key: str = "doc_id", id_col: str = "id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, chunks, ids) for storing together: a document whose key is stored already keeps the stored id, and its
    chunks, children and roots point to that; ids: old, new of those that changed.
    """
    stored = existing.groupBy(key).agg(F.min(id_col).alias("_new"))
    ids = documents.join(stored, key).filter(F.col(id_col) != F.col("_new")).select(F.col(id_col).alias("old"), F.col("_new").alias("new")).distinct()

    def moved(df: DataFrame, column: str) -> DataFrame:
        mapped = ids.select(F.col("old").alias(column), F.col("new").alias("_moved"))
        return df.join(mapped, column, "left").withColumn(column, F.coalesce("_moved", column)).drop("_moved").select(*df.columns)

    for column in (id_col, "parent_id", "root_id"):
        documents = moved(documents, column) if column in documents.columns else documents
    return documents, moved(chunks, "document_id"), ids
