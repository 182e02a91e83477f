"""From parsed e-mails to chunks: what to do with a file, how to cut its text, and which rows follow."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.cuts import cut
from dossier.functions import email, ids, shape
from dossier.functions import text as txt

CHUNK_TOKENS, OVERLAP_TOKENS, LEAST_WORDS = 1024, 100, 5
LEAST_MESSAGE_WORDS = 20


def decide(files: DataFrame, documents: DataFrame, current_version: int) -> DataFrame:
    """files (source_id, file_hash) with doc_id and action: insert, update, skip or reprocess."""
    keyed = files.withColumn("doc_id", ids.doc_id(F.col("source_id"), F.col("file_hash")))
    same = documents.groupBy("doc_id").agg(F.max(F.coalesce("ingest_version", F.lit(1))).alias("_version"))
    source = documents.select("source_id").distinct().withColumn("_source", F.lit(True))
    action = (
        F.when(F.col("_version") < current_version, "reprocess").when(F.col("_version").isNotNull(), "skip").when(F.col("_source"), "update").otherwise("insert")
    )
    return keyed.join(same, "doc_id", "left").join(source, "source_id", "left").withColumn("action", action).drop("_version", "_source")


def pending(files: DataFrame, log: DataFrame, done: tuple[str, ...] = ("COMPLETED",)) -> DataFrame:
    """Files whose hash is in no log row of a status that counts as done."""
    return files.join(log.filter(F.upper("status").isin(*done)).select("file_hash").distinct(), "file_hash", "left_anti")


def wave(files: DataFrame, existing: DataFrame, n: int, key: str = "doc_id") -> DataFrame:
    """The first n new keys in order: a wave of an import."""
    return files.join(existing.select(key).distinct(), key, "left_anti").orderBy(key).limit(n)


def with_hierarchy(documents: DataFrame) -> DataFrame:
    """depth, root_id and path from parent_id; rows outside any tree go.

    A root's path holds its own id; any other's is its parent's path and then the parent's id.

    Every node knows the ids above it up to some ancestor; each round joins it with what that ancestor knows, which doubles
    the distance. The rounds are the logarithm of the depth, whatever the number of nodes; a cycle has no root and ends them.
    """
    known = documents.select("id", F.col("parent_id").alias("top"), F.when(F.col("parent_id").isNull(), F.array().cast("array<string>")).otherwise(F.array(F.col("parent_id").cast("string"))).alias("path"))
    known, open_before = cut(known, "tree"), None
    while True:
        still = known.filter("top is not null").count()
        if still in (0, open_before):
            break
        open_before = still
        above = known.select(F.col("id").alias("top"), F.col("top").alias("next"), F.col("path").alias("before"))
        rest = known.filter("top is not null").join(above, "top").select("id", F.col("next").alias("top"), F.concat("before", "path").alias("path"))
        known = cut(known.filter("top is null").unionByName(rest), "tree")
    kind = documents.schema["id"].dataType.simpleString()
    above = F.col("path").cast(f"array<{kind}>")
    done = known.filter("top is null").select("id", F.size("path").alias("depth"), F.coalesce(F.get(above, F.lit(0)), F.col("id")).alias("root_id"), above.alias("above"))
    done = done.select("id", "depth", "root_id", F.concat(F.array("root_id"), "above").alias("path"))
    return documents.drop("root_id", "depth", "path").join(done, "id")


def message_chunks(bodies: DataFrame, doc: str = "doc_id", body: str = "body", least_words: int = LEAST_MESSAGE_WORDS) -> tuple[DataFrame, DataFrame]:
    """(chunks, filtered): a chunk per cleaned message of enough words; the others with the reason they go."""
    parts = bodies.select(doc, F.posexplode(email.messages(F.col(body))).alias("chunk_index", "content"))
    parts = parts.withColumn("embedding_text", email.without_boilerplate(F.col("content"))).withColumn("words", F.size(F.filter(F.split("embedding_text", r"\s+"), lambda w: w != "")))
    long = F.col("words") >= least_words
    start = ids.fallback_start(F.col("chunk_index"), F.col("content"))
    made = parts.filter(long).withColumn("chunk_id", ids.chunk_id(F.col(doc), start, start + F.length("content")))
    return made.drop("words"), parts.filter(~long).select(doc, "chunk_index", "words", F.lit("message_filtered").alias("event_type"), F.lit("too_short").alias("reason"))


def word_windows(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = CHUNK_TOKENS, overlap: int = OVERLAP_TOKENS) -> DataFrame:
    """key, chunk_index, content: windows of `size` words that share `overlap`, natively; words are runs without white space."""
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"\s+"), lambda w: w != "")
    n, step = F.size("_words"), size - overlap
    starts = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - overlap - 1, F.lit(0)), F.lit(step)))
    windows = docs.select(key, words.alias("_words")).select(key, F.posexplode(F.transform(starts, lambda s: F.array_join(F.slice("_words", s + 1, size), " "))).alias("chunk_index", "content"))
    return windows.filter(F.size(F.split("content", " ")) >= LEAST_WORDS)


def split_text(text: str, size: int, overlap: int, count: Callable[[str], int]) -> list[str]:
    """Recursive split at headings, paragraphs, lines, sentences, then words, joined again up to size."""
    marks = ("\n# ", "\n## ", "\n### ", "\n\n", "\n", ". ", " ")

    def pieces(part: str, level: int) -> list[str]:
        if count(part) <= size or level == len(marks):
            return [part]
        mark = marks[level]
        parts = part.split(mark)
        whole = [parts[0], *[mark.lstrip() + p if mark.startswith("\n#") else p for p in parts[1:]]]
        if mark == ". ":
            whole = [p + "." for p in parts[:-1]] + parts[-1:]
        return [q for p in whole if p.strip() for q in pieces(p, level + 1)]

    out, held = [], []
    for p in pieces(text, 0):
        if held and count(" ".join([*held, p])) > size:
            out.append(" ".join(held))
            while held and count(" ".join(held)) > overlap:
                held.pop(0)
        held.append(p.strip())
    return [*out, " ".join(held)] if held else out


def recursive_chunks(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = CHUNK_TOKENS, overlap: int = OVERLAP_TOKENS, count: Callable[[str], int] | None = None) -> DataFrame:
    """key, chunk_index, content: markdown-aware chunks by a pluggable token count (default: words); under 5 words dropped."""
    counter = count or (lambda t: len(t.split()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k, t in zip(b[key], b[text], strict=True):
                parts = [p for p in split_text(t or "", size, overlap, counter) if len(p.split()) >= LEAST_WORDS]
                yield pd.DataFrame({key: pd.Series([k] * len(parts), dtype=b[key].dtype), "chunk_index": pd.Series(range(len(parts)), dtype="int32"), "content": pd.Series(parts, dtype=object)})

    return docs.select(key, text).mapInPandas(run, f"{key} {docs.schema[key].dataType.simpleString()}, chunk_index int, content string")


def located(chunks: DataFrame, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """chunks with char_start, char_end, line_from and line_to in the document; null where a chunk cannot be placed."""
    both = chunks.join(docs.select(key, F.col(text).alias("_text")), key)
    start = txt.find_chunk(F.col("_text"), F.col("content"), F.lit(0))
    placed = both.withColumn("char_start", start).withColumn("char_end", F.col("char_start") + F.length("content"))
    return placed.withColumns({"line_from": txt.line_of(F.col("_text"), F.col("char_start")), "line_to": txt.line_of(F.col("_text"), F.col("char_end") - 1)}).drop("_text")


def summary_of(text: Column, longest: int = 500) -> Column:
    """The default summariser: the head of the text."""
    return F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, longest)


def mode_chunks(docs: DataFrame, summarise: Callable[[Column], Column] = summary_of, size: int = CHUNK_TOKENS, overlap: int = OVERLAP_TOKENS) -> DataFrame:
    """Chunks of documents (doc_id, text, file_name, kind, title, subject) as their content's shape asks for.

    full: word windows; summary: one summary; metadata_only: one stub of what is known of the file.
    """
    shaped = shape.with_shape(docs).withColumn("decision", shape.embedding_mode())
    mode = F.col("decision.mode")
    none = F.lit(0)
    full = word_windows(shaped.filter(mode == "full"), size=size, overlap=overlap).withColumns({"embedding_mode": F.lit("full"), "char_start": F.lit(None).cast("int"), "char_end": F.lit(None).cast("int")})
    short = shaped.filter(mode == "summary").select("doc_id", none.alias("chunk_index"), summarise(F.col("text")).alias("content"), F.lit("summary").alias("embedding_mode"), F.lit(ids.SUMMARY[0]).alias("char_start"), F.lit(ids.SUMMARY[1]).alias("char_end"))
    stub = shaped.filter(mode == "metadata_only").select("doc_id", none.alias("chunk_index"), txt.metadata_stub(F.col("file_name"), F.col("kind"), F.col("title"), F.col("subject")).alias("content"), F.lit("metadata_only").alias("embedding_mode"), F.lit(ids.METADATA[0]).alias("char_start"), F.lit(ids.METADATA[1]).alias("char_end"))
    start = F.coalesce("char_start", ids.fallback_start(F.col("chunk_index"), F.col("content")))
    out = full.unionByName(short).unionByName(stub)
    return out.withColumn("chunk_id", ids.chunk_id(F.col("doc_id"), start, F.coalesce("char_end", start + F.length("content"))))


def digests(messages: DataFrame, thread: str, text: str, order: str, summarise: Callable[[Column], Column] = summary_of, longest: int = 4000) -> DataFrame:
    """One digest per thread of two or more messages: a summary of its messages in order.

    The summary reads the first `longest` characters of the joined messages, at most. Where a message begins is a running
    sum, so only those that begin within them are brought together, however long the thread.
    """
    at = Window.partitionBy(thread).orderBy(order, text)
    # each message takes two characters at least, so the first longest / 2 of a thread suffice: tasks drop the rest early
    first = messages.withColumn("_nth", F.row_number().over(at)).filter(F.col("_nth") <= longest // 2)
    start = F.coalesce(F.sum(F.length(text) + 2).over(at.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    part = F.struct(F.col("_start").alias("o"), F.col("_nth").alias("k"), F.substring(text, 1, longest).alias("t"))
    held = first.withColumn("_start", start).filter(F.col("_start") < longest).groupBy(thread).agg(F.array_sort(F.collect_list(part)).alias("m"))
    rows = messages.groupBy(thread).agg(F.count("*").alias("n")).join(held, thread)
    joined = F.substring(F.array_join(F.transform("m", lambda m: m["t"]), "\n\n"), 1, longest)
    return rows.filter("n >= 2").select(thread, "n", summarise(joined).alias("digest"), F.lit(ids.DIGEST[0]).alias("chunk_index"))


def mode_drift(docs: DataFrame, current: str = "embedding_mode") -> DataFrame:
    """Documents whose stored mode is no longer what the rules say: doc_id, current, proposed, reason."""
    shaped = shape.with_shape(docs).withColumn("decision", shape.embedding_mode())
    return shaped.filter(~F.col(current).eqNullSafe(F.col("decision.mode"))).select("doc_id", F.col(current).alias("current"), F.col("decision.mode").alias("proposed"), F.col("decision.reason").alias("reason"))


def never_tagged(chunks: DataFrame, document: str = "document_id") -> DataFrame:
    """Documents none of whose chunks has topics or was checked for them."""
    tagged = F.coalesce(F.size("topic_ids") > 0, F.lit(False)) | F.coalesce(F.col("topics_checked"), F.lit(False))
    return chunks.groupBy(document).agg(F.bool_or(tagged).alias("_any")).filter("not _any").select(document)


def results(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """One JSON summary per root: its documents, chunks by mode and different entities."""
    counts = chunks.groupBy(F.col("document_id").alias("id")).agg(*[F.count_if(F.col("embedding_mode") == m).alias(m) for m in ("full", "summary", "metadata_only")])
    rolled = documents.join(counts, "id", "left").groupBy("root_id").agg(
        F.count("*").alias("documents"), *[F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in ("full", "summary", "metadata_only")], F.array_sort(F.array_distinct(F.flatten(F.collect_list("entity_ids")))).alias("entity_ids")
    )
    return rolled.select("root_id", F.to_json(F.struct(*[c for c in rolled.columns])).alias("result"))
