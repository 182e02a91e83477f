"""SQL functions against the DataFrame operators that they stand for."""

import pytest
from pyspark.sql import functions as F

from dossier import sql
from dossier.operators import ingest, retrieval


@pytest.fixture(scope="module")
def tables(spark):
    chunks = spark.createDataFrame(
        [("c1", "b", "the pump seal", [1.0, 0.0], ["t1"], {"vessels": ["v1", "v2"]}), ("c2", "a", "nothing", [0.9, 0.1], ["t2", "t1"], {"vessels": ["v1"]}), ("c3", "b", "pump", [0.5, 0.5], ["t3"], None), ("c4", "b", None, None, None, None)],
        "chunk_id string, document_id string, content string, embedding array<double>, topic_ids array<string>, metadata map<string, array<string>>",
    )
    tree = spark.createDataFrame([("r", None, "subject"), ("a", "r", None), ("b", "a", None)], "id string, parent_id string, email_subject string")
    topics = spark.createDataFrame([("t1", "A", [1.0, 0.0], 3, 1), ("t2", "B", [0.7, 0.7], 1, 1), ("t3", "C", None, 0, 0)], "id string, name string, embedding array<double>, chunk_count bigint, document_count bigint")
    documents = ingest.with_hierarchy(tree)
    sql.register(spark, chunks, documents, topics)
    return chunks, documents, topics


def test_match_chunks(spark, tables):
    chunks, documents, _ = tables
    query = F.array(F.lit(1.0), F.lit(0.0))
    for text, topics in ((None, None), ("pump", None), ("pump", ["t1"]), ("", ["t2", "t3"])):
        got = spark.sql("SELECT chunk_id, round(similarity, 9) AS s, root_uuid, email_subject FROM match_chunks(array(1D, 0D), 0.1D, 3, topics => {t}, query_text => {q})".replace("{t}", "NULL" if topics is None else f"array({str(topics)[1:-1]})").replace("{q}", "NULL" if text is None else f"'{text}'"))
        want = retrieval.match_chunks(chunks, documents, query, 0.1, 3, topic_ids=topics, text=text, inherited=("email_subject",)).select("chunk_id", F.round("similarity", 9).alias("s"), "root_uuid", "email_subject")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_a_limit_is_a_bounded_top_k(spark, tables):
    plan = spark.sql("SELECT * FROM match_chunks(array(1D, 0D), 0.1D, 3)")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject(limit=60" in plan


def test_lateral_calls_and_filters(spark, tables):
    rows = lambda q: [tuple(r) for r in spark.sql(q).collect()]
    assert rows("SELECT d.id, a.id FROM documents d, LATERAL get_document_ancestry(d.id) a ORDER BY d.id, a.depth") == [("a", "r"), ("a", "a"), ("b", "r"), ("b", "a"), ("b", "b"), ("r", "r")]
    assert rows("SELECT t.id, m.chunk_id FROM topics t, LATERAL match_chunks(t.embedding, 0.1D, 1) m ORDER BY 1") == [("t1", "c1"), ("t2", "c3")]
    assert rows("SELECT count_chunks_by_topics(array('t1', 't3')), count_chunks_by_topics(array('t1', 't3'), array('vessels=v2')), count_chunks_by_topic('t1', array('vessels=v1'))") == [(3, 1, 2)]
    assert rows("SELECT chunk_id FROM match_chunks(array(1D, 0D), 0.1D, 9, wanted => array('vessels=v1', 'vessels=v2'))") == [("c1",)]
    assert rows("SELECT id FROM find_similar_topics(array(0.7D, 0.7D))") == [("t2",)]
    assert rows("SELECT chunk_id, topic_ids FROM rewrite_chunk_topic_ids(map('t2', 't1')) ORDER BY 1") == [("c2", ["t1"])]
