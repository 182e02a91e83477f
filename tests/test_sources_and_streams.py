"""Files and streams."""

import datetime as dt
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from dossier.sources import files
from dossier.streaming import events

MAIL = (
    b"\xef\xbb\xbfFrom: =?utf-8?q?J=C3=B6rg?= <J@X.org>\r\nTo: a@b.c, d@e.f\r\nDate: Thu, 13 Mar 2025 08:34:00 +0200\r\nSubject: =?utf-8?b?w6k=?=\r\nMIME-Version: 1.0\r\n"
    b'Content-Type: multipart/mixed; boundary="B"\r\n\r\n--B\r\nContent-Type: text/plain; charset=windows-1252\r\n\r\ncaf\xe9\r\n--B\r\nContent-Type: application/pdf; name="r.pdf"\r\n'
    b"Content-Disposition: attachment; filename=r.pdf\r\nContent-Transfer-Encoding: base64\r\n\r\nAAEC\r\n--B\r\nContent-Type: message/rfc822\r\n\r\nSubject: inner\r\n\r\nhello\r\n--B--\r\n"
)


def test_mail(spark):
    df = spark.createDataFrame([("a.eml", bytearray(MAIL)), ("b.eml", bytearray(b""))], "path string, content binary")
    a, b = files.parse_eml(df).orderBy("path").collect()
    assert (a.subject, a.sender, a.recipients, a.body.strip()) == ("é", "Jörg <J@X.org>", ["a@b.c", "d@e.f"], "café")
    assert a.sent == dt.datetime(2025, 3, 13, 6, 34)
    assert [(x.name, x.mime) for x in a.attachments] == [("r.pdf", "application/pdf"), ("inner.eml", "message/rfc822")] and bytes(a.attachments[0].content) == b"\x00\x01\x02"
    assert b.subject is None and b.error is None
    t = files.threads(files.parse_eml(df).filter("subject is not null"), F.lit("t")).first()
    assert (t.participants, t.initiator, t.messages) == (["a@b.c", "d@e.f", "j@x.org"], "j@x.org", 1)
    assert files.peek_attachments(files.parse_eml(df)).count() == 2


def packed(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, content in members.items():
            z.writestr(name.replace("__", "/").replace("_dot_", "."), content)
    return out.getvalue()


def test_zip(spark):
    inner = packed(x_dot_txt=b"1")
    raw = packed(a_dot_txt=b"2", inner_dot_zip=inner, _dot_hidden=b"3", __etc__passwd=b"4")
    df = spark.createDataFrame([("z.zip", bytearray(raw)), ("bad.zip", bytearray(b"no"))], "path string, content binary")
    got = {(r.archive, r.member, r.depth, r.error) for r in files.expand_zip(df).collect()}
    assert got == {("z.zip", "a.txt", 1, None), ("z.zip/inner.zip", "x.txt", 2, None), ("bad.zip", None, 1, "bad_zip")}
    assert not files.safe_member("../x") and not files.safe_member("C:/x") and files.safe_member("a/b.txt")


def test_tables_and_registers(spark, tmp_path):
    df = spark.createDataFrame([(bytearray(b"a;b\r1;x|y\x00junk"),)], "content binary")
    assert files.csv_as_markdown(df).first().markdown == "| a | b |\n|---|---|\n| 1 | x\\|y |"
    quoted = b'name,note\n"Smith, J","said ""no"",\nthen left"\nplain,\n\n;x\x00\x01\nbinary\n"'
    df = spark.createDataFrame([(bytearray(quoted),)], "content binary")
    assert files.csv_as_markdown(df).first().markdown == '| name | note |\n|---|---|\n| Smith, J | said "no", then left |\n| plain |  |\n| ;x |  |'
    (tmp_path / "r.csv").write_text("NAME;TYPE;CLASS;ALIASES\nBlue;t;c;B1, B2\nNo Class;t;;\n")
    r = files.register(spark, str(tmp_path / "r.csv")).collect()
    assert [(x.name, x.aliases) for x in r] == [("Blue", ["B1", "B2"])]
    (tmp_path / "l.jsonl").write_text('{"a": 1}\nnot json\n\n{"a": 2, "b": "x"}\n')
    good, bad = files.json_lines(spark, str(tmp_path / "l.jsonl"), "a int, b string")
    assert sorted(r.a for r in good.collect()) == [1, 2] and bad.first().value == "not json"
    (tmp_path / "mail" / "sub").mkdir(parents=True)
    (tmp_path / "mail" / "sub" / "A.eml").write_bytes(MAIL)
    found = files.discover(spark, str(tmp_path / "mail")).collect()
    assert [r.source_id for r in found] == ["sub/a.eml"]
    assert files.listing(spark, str(tmp_path / "mail")).count() == 1


def log(spark):
    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    rows = [("a", "PROCESSING", at(0), None), ("a", "FAILED", at(1), "x"), ("a", "PROCESSING", at(2), None), ("a", "COMPLETED", at(5), None), ("b", "PROCESSING", at(3), None)]
    return spark.createDataFrame(rows, "file_path string, status string, at timestamp, error string")


def stream_of(spark, df, path):
    df.write.parquet(str(path))
    return spark.readStream.schema(df.schema).parquet(str(path))


def drained(query_frame, name, mode, tmp_path):
    q = query_frame.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"c-{name}")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return query_frame.sparkSession.table(name)


def test_file_states_stream_equals_batch(spark, tmp_path):
    got = drained(events.file_states(stream_of(spark, log(spark), tmp_path / "in")), "states", "update", tmp_path)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, events.fold_files(log(spark)).collect()))


def test_windows_stream_equals_batch(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, 1, h, m), "ab"[m % 2]) for h in range(3) for m in range(0, 60, 7)]
    df = spark.createDataFrame(rows, "ts timestamp, kind string")
    s = stream_of(spark, df, tmp_path / "in")
    for name, f in (("tumbling", lambda x: events.windowed_counts(x, "ts", ["kind"], "1 hour")), ("sliding", lambda x: events.windowed_counts(x, "ts", ["kind"], "1 hour", "30 minutes"))):
        assert sorted(map(tuple, drained(f(s), name, "complete", tmp_path).collect())) == sorted(map(tuple, f(df).collect()))
    sessions = events.session_counts(df, "ts", ["kind"], "20 minutes")
    assert sessions.agg(F.sum("n")).first()[0] == len(rows)


def test_batches_add_rows_once(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1,)], "k int").write.parquet(path)
    add = events.append_new(lambda: spark.read.parquet(path), lambda df: df.write.mode("append").parquet(path), "k")
    batch = spark.createDataFrame([(1,), (2,), (2,)], "k int")
    for i in (0, 0):
        add(batch, i)
    assert sorted(r.k for r in spark.read.parquet(path).collect()) == [1, 2]
    path = str(tmp_path / "versions")
    for k in (8, 9):
        files.write_atomic(spark.createDataFrame([(k,)], "k int"), path)
        assert [r.k for r in files.read_atomic(spark, path).collect()] == [k]
    held = files.read_atomic(spark, path)
    bad = spark.createDataFrame([(1,)], "k int").select(F.raise_error(F.lit("no")).cast("int").alias("k"))
    with pytest.raises(Exception, match="no"):  # a failed job leaves the old version in place
        files.write_atomic(bad, path)
    assert [r.k for r in files.read_atomic(spark, path).collect()] == [9] == [r.k for r in held.collect()]
    both = str(tmp_path / "together")
    files.write_atomic({"a": spark.range(2), "b": spark.range(3)}, both)
    assert (files.read_atomic(spark, both, "a").count(), files.read_atomic(spark, both, "b").count()) == (2, 3)


def test_refresh_and_trail(spark):
    held = {"df": spark.createDataFrame([(1, 1)], "k int, changed int")}
    cache = events.Refreshed(lambda: held["df"], "changed")
    assert cache.get() is cache.get()
    held["df"] = spark.createDataFrame([(1, 1), (2, 2)], "k int, changed int")
    assert cache.get().count() == 2
    steps = spark.createDataFrame([("d", "s", "parse", 1, "old"), ("d", "s", "parse", 2, "new"), ("d", "t", "embed", 1, "x")], "k string, slot string, step string, at int, record string")
    assert events.trail(steps, "k", "slot", "step", "at", "record").first().trail == {"s": {"parse": "new"}, "t": {"embed": "x"}}
