"""Queries written in SQL against the functions of dossier.sql."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier import sql
from dossier.operators.ingest import with_hierarchy
from dossier.plans.registry import query, table
from dossier.plans.search import _COSINE, _QUERY


def _tree(spark: SparkSession, sf: str) -> DataFrame:
    """Regions, nations and suppliers as one tree of documents."""
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    r = table(spark, sf, "region").select(name("r", "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent_id"), F.col("r_name").alias("file_name"))
    n = table(spark, sf, "nation").select(name("n", "n_nationkey").alias("id"), name("r", "n_regionkey").alias("parent_id"), F.col("n_name").alias("file_name"))
    s = table(spark, sf, "supplier").select(name("s", "s_suppkey").alias("id"), name("n", "s_nationkey").alias("parent_id"), F.col("s_name").alias("file_name"))
    return with_hierarchy(r.unionByName(n).unionByName(s))


def registered(spark: SparkSession, sf: str) -> None:
    """The functions over vectors as chunks, documents as their own roots' children, and labels as topics."""
    e, d = table(spark, sf, "embeddings"), table(spark, sf, "documents")
    texts = d.select(F.col("doc_id").alias("vec_id"), F.coalesce("text", F.lit("")).alias("content"))
    chunks = e.join(texts, "vec_id", "left").select(
        F.col("vec_id").alias("chunk_id"), F.col("vec_id").alias("document_id"), "content", "embedding",
        F.array(F.col("label").cast("string"), (F.col("label") + 10).cast("string")).alias("topic_ids"), F.create_map(F.lit("kinds"), F.array((F.col("vec_id") % 3).cast("string"))).alias("metadata"),
    )
    documents = d.select(F.col("doc_id").alias("id"), (F.col("doc_id") - F.col("doc_id") % 10).alias("root_id"), F.col("source").alias("file_path"), F.when(F.col("lang") != "en", F.col("lang")).alias("email_subject"))
    topics = e.groupBy(F.col("label").cast("string").alias("id")).agg(F.count("*").alias("chunk_count"), F.min_by("embedding", "vec_id").alias("embedding"))
    sql.register(spark, chunks, documents, topics.withColumns({"name": F.concat(F.lit("topic "), "id"), "document_count": F.col("chunk_count")}))


@query("u01_match_chunks", f"""WITH {_QUERY}, c AS (SELECT e.vec_id, {_COSINE} AS cosine FROM embeddings e, q WHERE {_COSINE} > 0 AND (label IN (0, 3) OR label + 10 IN (0, 3)) AND vec_id % 3 = 1 ORDER BY cosine DESC, e.vec_id LIMIT 60),
    t AS (SELECT c.*, d.doc_id, d.lang, d.source, d.doc_id - d.doc_id % 10 AS root_id, regexp_extract_all(lower(coalesce(d.text, '')), '[a-z0-9]+') AS w FROM c JOIN documents d ON d.doc_id = c.vec_id),
    s AS (SELECT *, CASE WHEN list_contains(w, 'the') THEN 0.7 * cosine + 0.3 * least(1.0, len(list_filter(w, lambda x: x = 'the'))::DOUBLE / len(w)) ELSE cosine END AS similarity FROM t)
    SELECT vec_id::VARCHAR AS chunk_id, round(similarity, 6) AS similarity, r.doc_id::VARCHAR AS root_uuid, s.source AS file_path, r.source AS root_file_path, coalesce(CASE WHEN s.lang <> 'en' THEN s.lang END, CASE WHEN r.lang <> 'en' THEN r.lang END) AS email_subject
    FROM s LEFT JOIN documents r ON r.doc_id = s.root_id ORDER BY s.similarity DESC, vec_id::VARCHAR LIMIT 12""")
def u01_match(spark: SparkSession, sf: str) -> DataFrame:
    registered(spark, sf)
    wanted = ", ".join(f"{float(x)!r}D" for x in table(spark, sf, "embeddings").filter("vec_id = 0").select("embedding").limit(1).collect()[0][0])
    call = f"match_chunks(array({wanted}), 0D, 12, topics => array('0', '3'), wanted => array('kinds=1'), query_text => 'the')"
    return spark.sql(f"SELECT chunk_id, round(similarity, 6) AS similarity, root_uuid, file_path, root_file_path, email_subject FROM {call}")


@query("u01_ancestry", """WITH RECURSIVE node AS (SELECT 'r' || r_regionkey AS id, NULL AS parent_id, r_name AS file_name FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, s_name FROM supplier),
    t(id, above) AS (SELECT id, id FROM node UNION ALL SELECT t.id, n.parent_id FROM t JOIN node n ON n.id = t.above WHERE n.parent_id IS NOT NULL),
    depths AS (SELECT id, CAST(count(*) - 1 AS INTEGER) AS depth FROM t GROUP BY id) SELECT t.id AS document, t.above AS ancestor, n.file_name, d.depth FROM t JOIN node n ON n.id = t.above JOIN depths d ON d.id = t.above""")
def u01_ancestry(spark: SparkSession, sf: str) -> DataFrame:
    """The table function joined laterally: the ancestry of every document."""
    none = spark.createDataFrame([], "chunk_id string, id string")
    sql.register(spark, none, _tree(spark, sf), none)
    return spark.sql("SELECT d.id AS document, a.id AS ancestor, a.file_name, a.depth FROM documents d, LATERAL get_document_ancestry(d.id) a")


@query("u01_similar_topics", """WITH t AS (SELECT label AS id, min(vec_id) AS vec_id FROM embeddings GROUP BY label), v AS (SELECT t.id, e.embedding::DOUBLE[] AS v FROM t JOIN embeddings e ON e.vec_id = t.vec_id),
    p AS (SELECT a.id AS topic, b.id AS similar_id, list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) AS s FROM v a, v b)
    SELECT topic::VARCHAR AS topic, similar_id::VARCHAR AS similar_id, round(s, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY s DESC, similar_id::VARCHAR) AS nth FROM p) WHERE nth <= 3 AND s > -1""")
def u01_topics(spark: SparkSession, sf: str) -> DataFrame:
    registered(spark, sf)
    return spark.sql("SELECT t.id AS topic, s.id AS similar_id, round(s.similarity, 6) AS similarity FROM topics t, LATERAL find_similar_topics(t.embedding, -1D, 3) s")


@query("u02_topic_counts", """SELECT t.id::VARCHAR AS id, (SELECT count(*) FROM embeddings e WHERE t.id IN (e.label, e.label + 10)) AS n, (SELECT count(*) FROM embeddings e WHERE t.id IN (e.label, e.label + 10) AND e.vec_id % 3 = 2) AS of_kind,
    (SELECT count(*) FROM embeddings e WHERE e.label IN (2, 3) OR e.label + 10 IN (2, 3)) AS of_two FROM (SELECT DISTINCT label AS id FROM embeddings) t""")
def u02(spark: SparkSession, sf: str) -> DataFrame:
    """Scalar functions in a select list."""
    registered(spark, sf)
    return spark.sql("SELECT id, count_chunks_by_topic(id) AS n, count_chunks_by_topic(id, array('kinds=2')) AS of_kind, count_chunks_by_topics(array('2', '3')) AS of_two FROM get_topics_with_counts()")


@query("u03_rewritten_ids", """SELECT vec_id::VARCHAR AS chunk_id, array_to_string(list_sort(list_distinct(list_transform([label::VARCHAR, (label + 10)::VARCHAR], lambda t: CASE t WHEN '2' THEN '14' WHEN '13' THEN '3' ELSE t END))), ',') AS topic_ids
    FROM embeddings WHERE label IN (2, 13) OR label + 10 IN (2, 13)""")
def u03(spark: SparkSession, sf: str) -> DataFrame:
    registered(spark, sf)
    return spark.sql("SELECT chunk_id, array_join(topic_ids, ',') AS topic_ids FROM rewrite_chunk_topic_ids(map('2', '14', '13', '3'))")
