"""Re-embedding and wipes of a stored library."""

import pytest
from pyspark.sql import functions as F

from dossier.operators import keygraph, reembed
from dossier.operators.keygraph import Edge
from dossier.sources import files


def chunked(docs):
    return docs.select(F.col("doc_id").alias("document_id"), F.explode(F.split("text", " ")).alias("content"), F.lit("made").alias("origin"))


def test_only_changed_documents_are_embedded_again(spark, tmp_path):
    """Kept chunks stay as they are, topics are carried over, gone documents lose theirs; a second run changes nothing."""
    path = str(tmp_path / "library")
    sha = lambda t: F.sha2(F.lit(t), 256)
    stored = spark.createDataFrame([(1, "full"), (2, "full"), (3, "full"), (4, "full"), (6, "full")], "doc_id int, embedding_mode string")
    texts = {1: "same", 2: "old text", 3: "mode", 4: "gone", 6: ""}
    digest = F.create_map(*[x for k, v in texts.items() for x in (F.lit(k), sha(v))])[F.col("doc_id")]
    chunks = spark.createDataFrame(
        [(1, "same", "old", ["t1"]), (2, "old", "old", ["t2", "t1"]), (2, "text", "old", ["t3"]), (3, "mode", "old", None), (4, "gone", "old", ["t4"])], "document_id int, content string, origin string, topic_ids array<string>"
    )
    files.write_atomic({"documents": stored.withColumn("text_digest", digest), "chunks": chunks}, path)
    now = spark.createDataFrame([(1, "same", "full"), (2, "new text here", "full"), (3, "mode", "summary"), (5, "fresh", "full"), (6, None, "full")], "doc_id int, text string, embedding_mode string")
    report = {r.doc_id: tuple(r)[1:] for r in reembed.run(spark, path, now, chunked).collect()}
    assert report == {1: ("keep", None, 0, 0, 1), 2: ("rebuild", "text", 2, 3, 0), 3: ("rebuild", "mode", 1, 1, 0), 4: ("drop", "gone", 1, 0, 0), 5: ("new", "new", 0, 1, 0), 6: ("keep", None, 0, 0, 0)}
    got = sorted((r.document_id, r.content, r.origin, r.topic_ids) for r in files.read_atomic(spark, path, "chunks").collect())
    assert got == [(1, "same", "old", ["t1"]), *((2, w, "made", ["t1", "t2", "t3"]) for w in ("here", "new", "text")), (3, "mode", "made", []), (5, "fresh", "made", [])]
    assert {r.action for r in reembed.run(spark, path, now, chunked).collect()} == {"keep"}
    assert {r.action for r in reembed.run(spark, path, now, chunked, force=True).collect()} == {"rebuild"}


def test_line_numbers(spark):
    docs = spark.createDataFrame([(1, "a\nb\nc\nd"), (2, None)], "doc_id int, text string")
    chunks = spark.createDataFrame([(1, 2, "b\nc\n", None, None), (1, None, "d", None, None), (1, None, "absent", None, None), (1, 0, "a", 9, 9), (2, None, "x", None, None), (3, 0, "y", 4, 4)], "document_id int, char_start int, content string, line_from int, line_to int")
    assert sorted(r.document_id for r in reembed.lines_missing(chunks).collect()) == [1, 2]
    got = {(r.document_id, r.content): (r.line_from, r.line_to) for r in reembed.with_lines(chunks, docs).collect()}
    assert got == {(1, "b\nc\n"): (2, 3), (1, "d"): (4, 4), (1, "absent"): (None, None), (1, "a"): (9, 9), (2, "x"): (None, None), (3, "y"): (4, 4)}


EDGES = [Edge("chunks", "document", "documents", "id"), Edge("documents", "parent", "documents", "id"), Edge("bridge", "chunk", "chunks", "id"), Edge("bridge", "topic", "topics", "id")]


def test_layers():
    assert keygraph.layers(["topics", "chunks", "bridge", "documents"], EDGES) == [["bridge"], ["chunks", "topics"], ["documents"]]
    with pytest.raises(ValueError, match="circle"):
        keygraph.layers(["a", "b"], [Edge("a", "x", "b", "id"), Edge("b", "y", "a", "id")])


def test_an_interrupted_wipe_goes_on_without_orphans(spark, tmp_path):
    tables = {
        "documents": spark.createDataFrame([(i, i // 2 if i else None) for i in range(20)], "id int, parent int"), "chunks": spark.createDataFrame([(i, i % 20) for i in range(60)], "id int, document int"),
        "topics": spark.createDataFrame([(i,) for i in range(5)], "id int"), "bridge": spark.createDataFrame([(i, i, i % 5) for i in range(60)], "id int, chunk int, topic int"),
    }
    library = keygraph.Library(spark, str(tmp_path / "l"), dict.fromkeys(tables, "id"), EDGES, ranges=2)
    library.store(tables)
    assert library.read("chunks").count() == 60
    left = []
    while keygraph.Library(spark, str(tmp_path / "l"), dict.fromkeys(tables, "id"), EDGES, ranges=2).wipe(most_steps=3):
        held = {name: library.read(name) for name in tables}
        between = [e for e in EDGES if e.child != e.parent]
        assert sum(r.orphans for r in keygraph.orphans(held, between).collect()) == 0
        left.append(sum(df.count() for df in held.values()))
    assert left == sorted(left, reverse=True) and left[-1] == 0 and library.progress().count() == 8
    (lost,) = keygraph.orphans({**tables, "topics": tables["topics"].filter("id < 4")}, EDGES[3:]).collect()
    assert tuple(lost) == ("bridge", "topic", "topics", 12)
