"""The library's searches as SQL: table functions and scalar functions on a session, over its views of chunks, documents and topics.

Table functions may be joined laterally, one call for each row of a query. A limit given as a number becomes a bounded top-k in each task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.operators.retrieval import LEAST_CANDIDATES, TEXT_SHARE, VECTOR_SHARE

CHUNKS = {"chunk_id": "STRING", "document_id": "STRING", "content": "STRING", "embedding": "ARRAY<DOUBLE>", "topic_ids": "ARRAY<STRING>", "metadata": "MAP<STRING, ARRAY<STRING>>"}
DOCUMENTS = {"id": "STRING", "root_id": "STRING", "path": "ARRAY<STRING>", "depth": "INT", "document_type": "STRING", "file_path": "STRING", "file_name": "STRING", "email_subject": "STRING"}
TOPICS = {"id": "STRING", "name": "STRING", "embedding": "ARRAY<DOUBLE>", "chunk_count": "BIGINT", "document_count": "BIGINT"}

# `wanted` is a list of key=value, all of which the metadata must hold; spelled out where a function that counts uses it, as Spark
# does not inline one function in another's subquery
_HOLDS = "(wanted IS NULL OR forall(wanted, w -> array_contains(coalesce(try_element_at(metadata, substring_index(w, '=', 1)), array()), substring(w, instr(w, '=') + 1))))"
_WORDS = "array_distinct(regexp_extract_all(lower({}), '[a-z0-9]+', 0))"

FUNCTIONS = (
    """vector_length(v ARRAY<DOUBLE>) RETURNS DOUBLE
    RETURN sqrt(aggregate(v, 0D, (s, x) -> s + x * x))""",
    """cosine(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE
    RETURN coalesce(try_divide(aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x), vector_length(a) * vector_length(b)), 0D)""",
    f"""text_share(content STRING, query STRING) RETURNS DOUBLE
    RETURN CASE WHEN size({_WORDS.format("query")}) > 0 AND size(array_except({_WORDS.format("query")}, {_WORDS.format("content")})) = 0
      THEN least(1D, size(filter(regexp_extract_all(lower(content), '[a-z0-9]+', 0), w -> array_contains({_WORDS.format("query")}, w))) / size(regexp_extract_all(lower(content), '[a-z0-9]+', 0))) END""",
    f"""holds_all(metadata MAP<STRING, ARRAY<STRING>>, wanted ARRAY<STRING>) RETURNS BOOLEAN
    RETURN {_HOLDS}""",
    f"""match_chunks(query_embedding ARRAY<DOUBLE>, match_threshold DOUBLE DEFAULT 0.7, match_count INT DEFAULT 10, topics ARRAY<STRING> DEFAULT NULL,
      wanted ARRAY<STRING> DEFAULT NULL, query_text STRING DEFAULT NULL)
    RETURNS TABLE (chunk_id STRING, document_uuid STRING, content STRING, similarity DOUBLE, root_uuid STRING, email_subject STRING, file_path STRING, root_file_path STRING)
    RETURN SELECT chunk_id, document_uuid, content, similarity, root_uuid, email_subject, file_path, root_file_path FROM (
      SELECT c.chunk_id, d.id AS document_uuid, c.content, c.similarity, r.id AS root_uuid, coalesce(d.email_subject, r.email_subject) AS email_subject, d.file_path, r.file_path AS root_file_path,
        row_number() OVER (ORDER BY c.similarity DESC, c.chunk_id) AS place
      FROM (SELECT n.*, coalesce({VECTOR_SHARE} * near + {TEXT_SHARE} * text_share(n.content, query_text), near) AS similarity FROM (
          SELECT m.*, row_number() OVER (ORDER BY near DESC, m.chunk_id) AS nth FROM (
            SELECT chunk_id, document_id, content, cosine(embedding, query_embedding) AS near FROM chunks
            WHERE embedding IS NOT NULL AND (topics IS NULL OR arrays_overlap(topic_ids, topics)) AND holds_all(metadata, wanted)) m
          WHERE near > match_threshold) n
        WHERE nth <= greatest(3 * match_count, {LEAST_CANDIDATES})) c
      JOIN documents d ON c.document_id = d.id LEFT JOIN documents r ON d.root_id = r.id)
    WHERE place <= match_count""",
    """get_document_ancestry(document_uuid STRING)
    RETURNS TABLE (id STRING, document_type STRING, file_path STRING, file_name STRING, depth INT, email_subject STRING)
    RETURN SELECT d.id, d.document_type, d.file_path, d.file_name, d.depth, d.email_subject
      FROM (SELECT explode(array_distinct(array_append(path, id))) AS above FROM documents WHERE id = document_uuid) a JOIN documents d ON d.id = a.above""",
    """find_similar_topics(query_embedding ARRAY<DOUBLE>, similarity_threshold DOUBLE DEFAULT 0.85, max_results INT DEFAULT 5)
    RETURNS TABLE (id STRING, name STRING, similarity DOUBLE)
    RETURN SELECT id, name, similarity FROM (SELECT n.*, row_number() OVER (ORDER BY similarity DESC, n.id) AS nth FROM (
        SELECT id, name, cosine(embedding, query_embedding) AS similarity FROM topics WHERE embedding IS NOT NULL) n)
      WHERE nth <= max_results AND similarity > similarity_threshold""",
    f"""count_chunks_by_topic(topic STRING, wanted ARRAY<STRING> DEFAULT NULL) RETURNS BIGINT
    RETURN SELECT count(*) FROM chunks WHERE array_contains(topic_ids, topic) AND {_HOLDS}""",
    f"""count_chunks_by_topics(topics ARRAY<STRING>, wanted ARRAY<STRING> DEFAULT NULL) RETURNS BIGINT
    RETURN SELECT count(DISTINCT chunk_id) FROM chunks WHERE arrays_overlap(topic_ids, topics) AND {_HOLDS}""",
    """get_topics_with_counts() RETURNS TABLE (id STRING, name STRING, chunk_count BIGINT, document_count BIGINT)
    RETURN SELECT id, name, chunk_count, document_count FROM topics""",
    """rewritten_topic_ids(topic_ids ARRAY<STRING>, mapping MAP<STRING, STRING>) RETURNS ARRAY<STRING>
    RETURN array_sort(array_distinct(transform(topic_ids, t -> coalesce(try_element_at(mapping, t), t))))""",
    """rewrite_chunk_topic_ids(mapping MAP<STRING, STRING>) RETURNS TABLE (chunk_id STRING, topic_ids ARRAY<STRING>)
    RETURN SELECT chunk_id, rewritten_topic_ids(topic_ids, mapping) FROM chunks WHERE arrays_overlap(topic_ids, map_keys(mapping))""",
)


def _view(df: DataFrame, columns: dict[str, str], name: str) -> None:
    """A view with these columns and types; those that df lacks are null."""
    df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in columns.items()]).createOrReplaceTempView(name)


def register(spark: SparkSession, chunks: DataFrame, documents: DataFrame, topics: DataFrame) -> None:
    """Makes the functions callable in spark.sql, over these tables."""
    for df, columns, name in ((chunks, CHUNKS, "chunks"), (documents, DOCUMENTS, "documents"), (topics, TOPICS, "topics")):
        _view(df, columns, name)
    for function in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {function}")
