"""Conversations: listing, history, changes and repair of tool messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def listing(conversations: DataFrame, owner: Column | None = None, limit: int = 20, offset: int = 0, search: str | None = None) -> DataFrame:
    """One page, newest first, with has_more: whether the page is full. A search asks for all its words in the title."""
    rows = conversations.filter(owner) if owner is not None else conversations
    for word in (search or "").lower().split():
        rows = rows.filter(F.array_contains(F.split(F.lower("title"), r"\W+"), word))
    page = rows.orderBy(F.desc_nulls_last("last_message_at"), F.desc("created_at"), "thread_id").offset(offset).limit(limit)
    return page.join(page.agg((F.count("*") == limit).alias("has_more")), F.lit(True))


def history(messages: DataFrame) -> DataFrame:
    """What users and assistants said: without empty messages and those that only call tools."""
    said = F.col("role").isin("user", "assistant") & (F.trim(F.coalesce("text", F.lit(""))) != "")
    return messages.filter(said).withColumn("sent_at", F.coalesce("sent_at", "checkpoint_at"))


def without_orphan_calls(messages: DataFrame, thread: str = "thread_id") -> DataFrame:
    """Tool calls that no tool message answers are dropped, and tool messages that answer no call.

    messages: thread, position, role, tool_calls array<string>, tool_call_id.
    """
    asked = messages.select(thread, F.explode("tool_calls").alias("call")).distinct()
    answered = messages.filter("role = 'tool'").select(thread, F.col("tool_call_id").alias("call")).distinct()
    both = asked.join(answered, [thread, "call"])
    kept = both.groupBy(thread).agg(F.collect_set("call").alias("_both"))
    rows = messages.join(kept, thread, "left").withColumn("_both", F.coalesce("_both", F.array().cast("array<string>")))
    rows = rows.filter((F.col("role") != "tool") | F.array_contains("_both", F.col("tool_call_id")))
    return rows.withColumn("tool_calls", F.array_intersect("tool_calls", "_both")).drop("_both")


def touched(conversations: DataFrame, messages: DataFrame, thread: str = "thread_id") -> DataFrame:
    """last_message_at moved to the newest message where that is later."""
    newest = messages.groupBy(thread).agg(F.max("sent_at").alias("_sent"))
    return conversations.join(newest, thread, "left").withColumn("last_message_at", F.greatest("last_message_at", "_sent")).drop("_sent")
