"""The mail format: nested messages and archives in batches and streams."""

import io
import os
import zipfile
from email.message import EmailMessage

import pytest

from dossier.operators.ingest import with_hierarchy
from dossier.sources import files, mail


def message(subject, body, *parts):
    m = EmailMessage()
    m["Subject"], m["From"], m["To"] = subject, "a@x.example", "b@x.example"
    m.set_content(body)
    for name, mime, content in parts:
        if mime == "message":
            m.add_attachment(content)
        else:
            kind, sub = mime.split("/")
            m.add_attachment(content, maintype=kind, subtype=sub, filename=name)
    return m


def packed(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, content in members.items():
            z.writestr(name, content)
    return out.getvalue()


@pytest.fixture
def folder(tmp_path):
    inner = message("inner", "deepest", ("n.txt", "application/octet-stream", b"n"))
    middle = message("middle", "between", ("", "message", inner), ("m.bin", "application/octet-stream", b"m"))
    archive = packed({"d/in.eml": message("zipped", "in a zip").as_bytes(), "../out.txt": b"no", "more.zip": packed({"x.txt": b"x"}), "same": b"1"})
    outer = message("outer", "top", ("", "message", middle), ("a.zip", "application/zip", archive), ("b.zip", "application/zip", b"broken"))
    where = tmp_path / "mail" / "box"
    where.mkdir(parents=True)
    (where / "1.eml").write_bytes(outer.as_bytes())
    (where / "2.eml").write_bytes(b"\xef\xbb\xbfSubject: second\r\n\r\nhello")
    (where / "note.txt").write_bytes(b"other suffix")
    return str(tmp_path / "mail")


def shape(rows, folder):
    cut = lambda p: p and p.removeprefix(folder)
    return sorted((cut(r.path), cut(r.parent), r.depth, r.kind, r.subject, (r.body or "").strip(), bytes(r.content) if r.content is not None else None, r.error) for r in rows)


def test_three_levels_of_nesting(spark, folder):
    spark.dataSource.register(mail.MailSource)
    rows = spark.read.format("mail").load(folder)
    got = {p: rest for p, *rest in shape(rows.collect(), folder)}
    top, inner = "/box/1.eml", "/box/1.eml/0-middle.eml"
    assert got[top][:4] == [None, 0, "message", "outer"] and got[inner][:5] == [top, 1, "message", "middle", "between"]
    assert got[f"{inner}/0-inner.eml"][:5] == [inner, 2, "message", "inner", "deepest"]
    assert got[f"{inner}/0-inner.eml/0-n.txt"][1:3] == [3, "file"] and got[f"{inner}/0-inner.eml/0-n.txt"][5] == b"n"
    assert got[f"{inner}/1-m.bin"][5] == b"m"
    assert got[f"{top}/1-a.zip/0-d/in.eml"][:5] == [f"{top}/1-a.zip", 2, "message", "zipped", "in a zip"]
    assert got[f"{top}/1-a.zip/1-more.zip/0-x.txt"][5] == b"x" and got[f"{top}/2-b.zip"][6] == "bad_zip"
    assert got["/box/2.eml"][3:5] == ["second", "hello"] and len(got) == 12 and not any("out.txt" in p or "note" in p for p in got)
    tree = {r.id.removeprefix(folder): r.depth for r in with_hierarchy(mail.with_parents(rows)).collect()}
    assert tree == {p: rest[1] for p, rest in got.items()}


def test_depth_limit(spark, folder):
    spark.dataSource.register(mail.MailSource)
    got = {r.path.removeprefix(folder): r.error for r in spark.read.format("mail").option("mostDepth", 1).load(folder).collect()}
    assert got["/box/1.eml/0-middle.eml/0-inner.eml"] == "too_deep" and "/box/1.eml/0-middle.eml/0-inner.eml/0-n.txt" not in got


def test_partitions_by_bytes(folder):
    options = mail._Options({"path": folder, "bytesPerPartition": "10"})
    listed = options.listed()
    assert [len(p.paths) for p in options.planned(listed)] == [1, 1] and [os.path.basename(p) for _, p, _ in sorted(listed, key=lambda f: f[1])] == ["1.eml", "2.eml"]
    options.most_bytes = 10**9
    assert [len(p.paths) for p in options.planned(listed)] == [2] and options.planned([]) == []


def test_stream_equals_batch(spark, folder, tmp_path):
    """A stream reads what is there, then only what comes; stopped and started again it goes on from its offset."""
    spark.dataSource.register(mail.MailSource)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def run():
        query = spark.readStream.format("mail").load(folder).writeStream.format("parquet").option("checkpointLocation", state).option("path", out).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None

    run()
    first = spark.read.parquet(out).count()
    new = os.path.join(folder, "box", "3.eml")
    with open(new, "wb") as f:
        f.write(message("third", "late").as_bytes())
    os.utime(new, ns=(2 * 10**18, 2 * 10**18))
    run()
    assert first == 12
    assert shape(spark.read.parquet(out).collect(), folder) == shape(spark.read.format("mail").load(folder).collect(), folder)


def test_same_rows_from_binary_files(spark, folder):
    spark.dataSource.register(mail.MailSource)
    found = files.discover(spark, folder, "*.eml")
    assert shape(mail.tree(found).collect(), folder) == shape(spark.read.format("mail").option("suffixes", ".eml").load(folder).collect(), folder)
