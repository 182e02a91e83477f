"""The format `mail`: folders of messages and archives as rows, a row for each message, attachment and archive member.

    spark.dataSource.register(MailSource)
    spark.read.format("mail").load(folder)
    spark.readStream.format("mail").load(folder)

A batch plans partitions of about `bytesPerPartition` of files. A stream keeps as its offset the newest file's time and path, and reads
files that come after it; a file must arrive whole and with its time of arrival, as by a rename. Where only Spark reaches the
files, tree() gives the same rows from its binaryFile source. Messages within messages and archives within archives are opened
down to `mostDepth`; each row names its parent's path, so a hierarchy is built from path and parent.

Defined cases: a file or member that cannot be read is a row with its error; a member that would leave its folder, and hidden
ones, are left out; an archive over the limits is a row with its error and no members; rows of one parent that share a name are told apart by their position.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from dossier.sources.files import MOST_BYTES, MOST_DEPTH, MOST_FILES, MOST_RATIO, parse_message, safe_member

COLUMNS = ("path", "parent", "depth", "position", "kind", "name", "mime", "subject", "sender", "recipients", "sent", "body", "content", "error")
ROWS = (
    "path string, parent string, depth int, position int, kind string, name string, mime string, subject string, sender string, "
    "recipients array<string>, sent timestamp, body string, content binary, error string"
)
BYTES_PER_PARTITION = 64 * 1024 * 1024
ARCHIVE_MIMES = frozenset({"application/zip", "application/x-zip-compressed"})


def _row(**given) -> tuple:
    return tuple(given.get(c) for c in COLUMNS)


def opened(path: str, name: str, mime: str | None, raw: bytes, parent: str | None = None, depth: int = 0, position: int = 0, most_depth: int = MOST_DEPTH) -> Iterator[tuple]:
    """The rows of one file: itself, and what is in it."""
    at = {"path": path, "parent": parent, "depth": depth, "position": position, "name": name, "mime": mime}
    lower = name.lower()
    if mime == "message/rfc822" or lower.endswith(".eml"):
        kind, inner = "message", _message
    elif mime in ARCHIVE_MIMES or lower.endswith(".zip"):
        kind, inner = "archive", _archive
    else:
        yield _row(**at, kind="file", content=raw)
        return
    if depth > most_depth:
        yield _row(**at, kind=kind, content=raw, error="too_deep")
        return
    own, parts = inner(raw)
    yield _row(**at, kind=kind, **own)
    for k, (part, part_mime, content) in enumerate(parts):
        yield from opened(f"{path}/{k}-{part}", part, part_mime, content, path, depth + 1, k, most_depth)


def _message(raw: bytes) -> tuple[dict, list[tuple]]:
    try:
        m = parse_message(raw)
    except Exception as e:  # a broken file is data, not a failure of the job
        return {"content": raw, "error": f"{type(e).__name__}: {e}"[:500]}, []
    return {k: m[k] for k in ("subject", "sender", "recipients", "sent", "body")}, [(a["name"].replace("/", "_"), a["mime"], a["content"]) for a in m["attachments"]]


def _archive(raw: bytes) -> tuple[dict, Iterator[tuple]]:
    try:
        z = zipfile.ZipFile(io.BytesIO(raw))
        held = [i for i in z.infolist() if not i.is_dir() and safe_member(i.filename)]
    except (zipfile.BadZipFile, ValueError, OSError):
        return {"content": raw, "error": "bad_zip"}, iter(())
    total, packed = sum(i.file_size for i in held), max(1, sum(i.compress_size for i in held))
    if len(held) > MOST_FILES or total > MOST_BYTES or total / packed > MOST_RATIO:
        return {"content": raw, "error": "over_limit"}, iter(())
    return {}, ((i.filename, None, z.read(i)) for i in held)


def tree(files: DataFrame, most_depth: int = MOST_DEPTH) -> DataFrame:
    """ROWS of files (path, content), as Spark's binaryFile source gives them, in a batch or a stream."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                rows = opened(path.removeprefix("file:"), path.rsplit("/", 1)[-1], None, bytes(content), most_depth=most_depth)
                yield pd.DataFrame(list(rows), columns=list(COLUMNS))

    return files.select("path", "content").mapInPandas(run, ROWS)


@dataclass
class Files(InputPartition):
    paths: list[str]


def _filesystem(folder: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder.removeprefix("file:"))


class _Options:
    def __init__(self, options):
        self.folder = options["path"]
        self.suffixes = tuple(x.strip().lower() for x in options.get("suffixes", ".eml,.zip").split(","))
        self.most_bytes = int(options.get("bytesPerPartition", BYTES_PER_PARTITION))
        self.most_depth = int(options.get("mostDepth", MOST_DEPTH))

    def listed(self) -> list[tuple[int, str, int]]:
        """(time of change in ns, path, bytes) of the files, in this order."""
        from pyarrow import fs

        system, folder = _filesystem(self.folder)
        found = system.get_file_info(fs.FileSelector(folder, recursive=True, allow_not_found=True))
        names = (f for f in found if f.type == fs.FileType.File and f.path.lower().endswith(self.suffixes) and not f.base_name.startswith((".", "_")))
        return sorted((f.mtime_ns or 0, f.path, f.size or 0) for f in names)

    def planned(self, listed: list[tuple[int, str, int]]) -> list[Files]:
        """Files in partitions of about most_bytes; a larger file is one of its own."""
        out, size = [Files([])], 0
        for _, path, n in listed:
            if out[-1].paths and size + n > self.most_bytes:
                out.append(Files([]))
                size = 0
            out[-1].paths.append(path)
            size += n
        return out if out[-1].paths else []

    def rows(self, part: Files) -> Iterator[tuple]:
        system, _ = _filesystem(self.folder)
        for path in part.paths:
            name = path.rsplit("/", 1)[-1]
            try:
                with system.open_input_stream(path) as f:
                    raw = f.read()
            except OSError as e:
                yield _row(path=path, depth=0, position=0, kind="file", name=name, error=f"{type(e).__name__}: {e}"[:500])
                continue
            yield from opened(path, name, None, raw, most_depth=self.most_depth)


class MailReader(DataSourceReader):
    def __init__(self, options: _Options):
        self.options = options

    def partitions(self) -> list[Files]:
        return self.options.planned(self.options.listed())

    def read(self, partition: Files) -> Iterator[tuple]:
        return self.options.rows(partition)


class MailStreamReader(DataSourceStreamReader):
    """Offsets are the newest file's (time, path); a batch reads the files after one offset and up to another."""

    def __init__(self, options: _Options):
        self.options = options

    def initialOffset(self) -> dict:
        return {"time": 0, "path": ""}

    def latestOffset(self) -> dict:
        listed = self.options.listed()
        return {"time": listed[-1][0], "path": listed[-1][1]} if listed else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Files]:
        after, upto = ((o["time"], o["path"]) for o in (start, end))
        return self.options.planned([f for f in self.options.listed() if after < f[:2] <= upto])

    def read(self, partition: Files) -> Iterator[tuple]:
        return self.options.rows(partition)

    def commit(self, end: dict) -> None:
        """Nothing is kept between batches."""


class MailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mail"

    def schema(self) -> str:
        return ROWS

    def reader(self, schema: StructType) -> MailReader:
        return MailReader(_Options(self.options))

    def streamReader(self, schema: StructType) -> MailStreamReader:
        return MailStreamReader(_Options(self.options))


def with_parents(rows: DataFrame) -> DataFrame:
    """(id, parent_id) rows for a hierarchy: paths are ids."""
    return rows.select(F.col("path").alias("id"), F.col("parent").alias("parent_id"), "kind", "name")
