"""Files as frames: e-mails, archives, tables, registers and tolerant JSON lines."""

from __future__ import annotations

import email
import email.policy
import io
import uuid
import zipfile
from collections.abc import Iterator
from datetime import UTC
from email.utils import parsedate_to_datetime
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.functions import ids, text

MOST_DEPTH, MOST_FILES, MOST_BYTES, MOST_RATIO = 3, 100, 500 * 1024 * 1024, 100
MESSAGE = (
    "path string, subject string, sender string, recipients array<string>, sent timestamp, message_id string, in_reply_to string, body string, "
    "attachments array<struct<name:string,mime:string,content:binary>>, error string"
)


def discover(spark: SparkSession, root: str, pattern: str = "*.eml") -> DataFrame:
    """path, content, file_hash and source_id of all files under root that match the pattern."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)
    return files.select("path", "content", F.sha2("content", 256).alias("file_hash"), ids.source_id(F.regexp_replace("path", "^file:", ""), root).alias("source_id"))


def listing(spark: SparkSession, root: str) -> DataFrame:
    """path, folder and length of all files under root, without their content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select("path", F.regexp_replace("path", "/[^/]*$", "").alias("folder"), "length")


def decoded(payload: bytes, charset: str | None) -> str:
    """By the declared charset, then UTF-8, then Windows-1252; what remains undecodable becomes U+FFFD."""
    for name in (charset, "utf-8", "cp1252"):
        try:
            if name:
                return payload.decode(name)
        except (LookupError, UnicodeDecodeError):
            continue
    return payload.decode("utf-8", "replace")


def parse_message(raw: bytes) -> dict:
    """The parts of one message. A nested message is an attachment named after its subject."""
    m = email.message_from_bytes(raw.removeprefix(b"\xef\xbb\xbf"), policy=email.policy.compat32)
    plain, marked, files = [], [], []
    header = lambda name: str(email.header.make_header(email.header.decode_header(m[name]))) if m[name] else None
    skip: set[int] = set()
    for part in m.walk():
        if id(part) in skip or (part.is_multipart() and part.get_content_type() != "message/rfc822"):
            continue
        kind = part.get_content_type()
        if kind == "message/rfc822":
            inner = part.get_payload(0)
            skip |= {id(x) for x in part.walk()}
            files.append({"name": f"{inner['Subject'] or 'message'}.eml", "mime": kind, "content": inner.as_bytes()})
            continue
        payload, name = part.get_payload(decode=True) or b"", part.get_filename()
        if name or part.get_content_disposition() == "attachment":
            files.append({"name": name or "unnamed", "mime": kind, "content": payload})
        elif kind in ("text/plain", "text/html"):
            (plain if kind == "text/plain" else marked).append(decoded(payload, part.get_content_charset()))
    sent = None
    if m["Date"]:
        try:
            sent = parsedate_to_datetime(m["Date"])
            sent = (sent if sent.tzinfo else sent.replace(tzinfo=UTC)).astimezone(UTC).replace(tzinfo=None)
        except (TypeError, ValueError):
            sent = None
    return {
        "subject": header("Subject"), "sender": header("From"), "recipients": [a.strip() for h in ("To", "Cc") if m[h] for a in header(h).split(",")], "sent": sent,
        "message_id": m["Message-ID"], "in_reply_to": m["In-Reply-To"], "body": "\n".join(plain) if plain else "\n".join(marked), "html": not plain and bool(marked), "attachments": files,
    }


def parse_eml(files: DataFrame) -> DataFrame:
    """MESSAGE rows of files (path, content); a file that cannot be parsed gives a row with its error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ("subject", "sender", "recipients", "sent", "message_id", "in_reply_to", "body", "attachments")
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"], strict=True):
                try:
                    parsed = parse_message(bytes(content))
                    rows.append({"path": path, **{k: parsed[k] for k in names}, "error": None})
                except Exception as e:  # a broken file is data, not a failure of the job
                    rows.append({"path": path, **dict.fromkeys(names), "error": f"{type(e).__name__}: {e}"[:500]})
            yield pd.DataFrame(rows, columns=["path", *names, "error"])

    return files.select("path", "content").mapInPandas(run, MESSAGE)


def peek_attachments(messages: DataFrame) -> DataFrame:
    return messages.select("path", F.transform("attachments", lambda a: F.struct(a["name"].alias("name"), a["mime"].alias("mime"))).alias("attachments"))


def threads(messages: DataFrame, key: Column) -> DataFrame:
    """Per thread: sorted participants, first sender, and first and last date."""
    people = F.concat(F.array("sender"), F.coalesce("recipients", F.array().cast("array<string>")))
    m = messages.select(key.alias("thread"), "sent", "sender", F.transform(people, text.address_of).alias("people"))
    return m.groupBy("thread").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("people")))).alias("participants"), F.min_by(text.address_of(F.col("sender")), F.coalesce("sent", F.lit("9999-12-31").cast("timestamp"))).alias("initiator"),
        F.min("sent").alias("first"), F.max("sent").alias("last"), F.count("*").alias("messages"),
    )


def safe_member(name: str) -> bool:
    """Whether an archive member stays inside its folder and is no hidden file."""
    p = PurePosixPath(name.replace("\\", "/"))
    return bool(p.parts) and not p.is_absolute() and ".." not in p.parts and not any(x.startswith(".") or x == "__MACOSX" for x in p.parts) and ":" not in p.parts[0]


def expand_zip(archives: DataFrame) -> DataFrame:
    """archive, member, depth, content, error: files of (path, content) archives, nested ones too, within the limits."""

    def members(path: str, raw: bytes, depth: int) -> Iterator[tuple]:
        if depth > MOST_DEPTH:
            yield path, None, depth, None, "too_deep"
            return
        try:
            z = zipfile.ZipFile(io.BytesIO(raw))
        except zipfile.BadZipFile:
            yield path, None, depth, None, "bad_zip"
            return
        held = [i for i in z.infolist() if not i.is_dir() and safe_member(i.filename)]
        total, packed = sum(i.file_size for i in held), max(1, sum(i.compress_size for i in held))
        if len(held) > MOST_FILES or total > MOST_BYTES or total / packed > MOST_RATIO:
            yield path, None, depth, None, "over_limit"
            return
        for i in held:
            content = z.read(i)
            if i.filename.lower().endswith(".zip"):
                yield from members(f"{path}/{i.filename}", content, depth + 1)
            else:
                yield path, i.filename, depth, content, None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                yield pd.DataFrame(list(members(path, bytes(content), 1)), columns=["archive", "member", "depth", "content", "error"])

    return archives.select("path", "content").mapInPandas(run, "archive string, member string, depth int, content binary, error string")


def csv_as_markdown(files: DataFrame, content: str = "content") -> DataFrame:
    """files with `markdown`: the CSV text (cut at the first NUL) as a table, by its most frequent separator of , ; and tab.

    Cells may be quoted: they then hold separators, line breaks and doubled quotes. Line breaks in cells become spaces.
    """
    plain = F.regexp_replace(F.regexp_replace(F.col(content).cast("string"), "(?s)\\x00.*", ""), "\r\n?", "\n")
    bare = F.regexp_replace("_t", '"(?:[^"]|"")*+"', "")  # separators in quotes do not count
    times = lambda c: F.length(bare) - F.length(F.replace(bare, F.lit(c), F.lit("")))
    sep = F.when((times(";") > times(",")) & (times(";") >= times("\t")), ";").when(times("\t") > times(","), "\t").otherwise(",")
    # a line, then a cell, is a run of quoted parts and of characters that do not end it
    lines = F.regexp_extract_all("_t", F.lit('(?:"(?:[^"]|"")*+"|[^\n"]|")++'), F.lit(0))
    cell = F.concat(F.lit('(?:^|'), F.col("_sep"), F.lit(')((?:"(?:[^"]|"")*+"|[^"'), F.col("_sep"), F.lit(']|")*+)'))
    clean = lambda c: F.regexp_replace(F.replace(F.regexp_replace(c, '^\\s*"((?s).*)"\\s*$', "$1"), F.lit('""'), F.lit('"')), "\n", " ")
    rows = F.transform(F.filter(lines, lambda x: F.trim(x) != ""), lambda line: F.transform(F.regexp_extract_all(line, cell, F.lit(1)), clean))
    return files.withColumn("_t", plain).withColumn("_sep", sep).withColumn("markdown", text.markdown_table(rows)).drop("_t", "_sep")


def register(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """name, type, class and aliases of a register file; rows without the first three are dropped.

    The separator is taken from the header line unless given.
    """
    if sep is None:
        head = spark.read.text(path).limit(1).collect()
        sep = ";" if head and head[0][0].count(";") >= head[0][0].count(",") else ","
    raw = spark.read.option("header", "true").option("sep", sep).csv(path)
    raw = raw.toDF(*[c.strip().lstrip("﻿").lower() for c in raw.columns])
    full = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    aliases = F.filter(F.transform(F.split(full("aliases") if "aliases" in raw.columns else F.lit(""), "[,|]"), lambda a: F.trim(a)), lambda a: a != "")
    out = raw.select(full("name").alias("name"), full("type").alias("type"), full("class").alias("class"), aliases.alias("aliases"))
    return out.filter("name <> '' and type <> '' and class <> ''").withColumn("id", F.substring(F.sha2(F.lower("name"), 256), 1, 32))


def json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, bad): good lines by schema, and the text of lines that are no JSON objects."""
    raw = spark.read.text(path).filter(F.trim("value") != "")
    parsed = raw.withColumn("row", F.from_json("value", f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"}))
    good = F.col("row").isNotNull() & F.col("row._corrupt").isNull()
    return parsed.filter(good).select("row.*").drop("_corrupt"), parsed.filter(~good).select("value")


def needs_ocr(pages: Column, has_form: Column, least: int = 50) -> Column:
    """Whether a PDF needs a heavy parser: it has form fields, or a page of hardly any text."""
    return has_form | F.exists(pages, lambda p: F.length(F.trim(p)) < least)


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder, jvm


def _point_to(spark: SparkSession, path: str, version: str) -> None:
    """Names the current version in a pointer file that is renamed over the old one: one operation of the file system."""
    fs, folder, jvm = _file_system(spark, path)
    fresh, current = (jvm.org.apache.hadoop.fs.Path(folder, name) for name in (f"_{version}", "_current"))
    out = fs.create(fresh, True)
    out.writeBytes(version)
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(fs.makeQualified(fresh), fs.makeQualified(current), options)


def current_version(spark: SparkSession, path: str) -> str:
    fs, folder, jvm = _file_system(spark, path)
    stream = fs.open(jvm.org.apache.hadoop.fs.Path(folder, "_current"))
    try:
        return bytes(stream.readNBytes(64)).decode()
    finally:
        stream.close()


def write_atomic(tables: DataFrame | dict[str, DataFrame], path: str, partition: list[str] | None = None) -> None:
    """Replaces a table, or several by name, in one step.

    The folder holds versions; each is written in full before the pointer names it. A failed job leaves the old version in
    place, and readers of it keep their files.
    """
    version = uuid.uuid4().hex
    each = {"": tables} if isinstance(tables, DataFrame) else {f"/{name}": df for name, df in tables.items()}
    for name, df in each.items():
        writer = df.write.partitionBy(*partition) if partition else df.write
        writer.parquet(f"{path}/{version}{name}")
    _point_to(df.sparkSession, path, version)


def read_atomic(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """The version that write_atomic() last put in place; name: which of several tables."""
    return spark.read.parquet(f"{path}/{current_version(spark, path)}" + (f"/{name}" if name else ""))
