"""Identity rules: every id is derived from content, so reruns and other engines agree."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Positions that stand for chunks without a place in the text.
SUMMARY, METADATA, IMAGE, DIGEST = (-1, 0), (-2, 0), -3, (-1, -1)


def source_id(path: Column, root: str) -> Column:
    """Lowercase path relative to the root, with forward slashes; the whole path if it lies elsewhere."""
    posix, base = F.replace(path, F.lit("\\"), F.lit("/")), root.replace("\\", "/").rstrip("/") + "/"
    return F.lower(F.when(F.startswith(posix, F.lit(base)), F.substring(posix, F.lit(len(base) + 1), F.length(posix))).otherwise(posix))


def attachment_source_id(parent: Column, file_name: Column) -> Column:
    return F.lower(F.concat_ws("/", parent, file_name))


def file_hash(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def _short(n: int, *parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]), 256), 1, n)


def doc_id(source: Column, content_hash: Column) -> Column:
    return _short(16, source, content_hash)


def folder_id(doc: Column) -> Column:
    return _short(32, F.lit("folder"), doc)


def chunk_id(doc: Column, start: Column, end: Column) -> Column:
    return _short(12, doc, start, end)


def fallback_start(index: Column, content: Column) -> Column:
    """The stand-in position of a chunk that cannot be found in its text."""
    return index * 1000 + F.crc32(F.encode(content, "utf-8")) % 1000
