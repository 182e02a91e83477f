"""Queries for operators that stand on their own: the stored index, named topics, stamps, flags, folders, remapped ids."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.cuts import scratch_dir
from dossier.functions import ids
from dossier.functions import text as txt
from dossier.operators import diff, dml, entities, fulltext, index, keygraph, quality, retrieval
from dossier.plans.registry import query, table
from dossier.plans.search import _COSINE, _QUERY, chunks, question

_NEAR = f"WITH {_QUERY}, n AS (SELECT e.vec_id, {_COSINE} AS s FROM embeddings e, q)"


def _vector_index(spark: SparkSession, sf: str) -> str:
    path = f"{scratch_dir(spark)}/dossier-index-{uuid.uuid4().hex}"
    index.build(chunks(spark, sf), path, cell_rows=40)
    return path


def _asked(spark: SparkSession, sf: str) -> list[float]:
    return [float(x) for x in table(spark, sf, "embeddings").filter("vec_id = 0").select("embedding").limit(1).collect()[0][0]]


@query("v03_index_search", f"{_NEAR} SELECT vec_id AS chunk_id, round(s, 6) AS cosine FROM n WHERE s > 0.1 ORDER BY s DESC, vec_id LIMIT 10")
def v03(spark: SparkSession, sf: str) -> DataFrame:
    """The ten nearest by a stored index of cells, read best first."""
    return index.search(spark, _vector_index(spark, sf), _asked(spark, sf), 10, 0.1).select("chunk_id", F.round("cosine", 6).alias("cosine"))


@query("v04_indexed_retrieve", f"""WITH {_QUERY}, c AS (SELECT e.vec_id, {_COSINE} AS s FROM embeddings e, q WHERE label IN (2, 5) AND {_COSINE} > 0 ORDER BY s DESC, vec_id LIMIT 60), s AS (SELECT c.vec_id, c.s FROM c JOIN documents d ON d.doc_id = c.vec_id)
    SELECT vec_id AS chunk_id, round(s, 6) AS similarity FROM s ORDER BY s DESC, chunk_id LIMIT 15""")
def v04_indexed(spark: SparkSession, sf: str) -> DataFrame:
    """Filtered search whose candidates come from the stored index."""
    near = index.search(spark, _vector_index(spark, sf), _asked(spark, sf), max(45, retrieval.LEAST_CANDIDATES), 0.0, where=retrieval.contains_any(F.col("topic_ids"), [2, 5]))
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.lit(None).cast("bigint").alias("root_id"))
    hits = retrieval.match_chunks(near.withColumn("content", F.lit("")), docs, None, 0.0, 15, found=True)
    return hits.select("chunk_id", F.round("similarity", 6).alias("similarity"))


_WORDS = "w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents), p AS (SELECT doc_id, unnest(w) AS lexeme, unnest(range(1, len(w) + 1)) AS place FROM w)"
_PAIR = "ln(1 - 0.1 * sqrt(1.0 / (1.005 + 0.05 * exp(least(abs(a.place - b.place) / 1.5 - 2, 80)))))"


def _index(spark: SparkSession, sf: str, english: bool) -> str:
    path = f"{scratch_dir(spark)}/dossier-words-{uuid.uuid4().hex}"
    fulltext.build(table(spark, sf, "documents"), path, "doc_id", "text", english)
    return path


@query("f10_indexed_text", f"WITH {_WORDS}, k AS (SELECT a.doc_id, 1 - exp(sum({_PAIR})) AS rank FROM p a JOIN p b ON a.doc_id = b.doc_id AND a.lexeme = 'the' AND b.lexeme = 'of' GROUP BY 1) SELECT doc_id, round(rank, 6) AS rank FROM k")
def f10_index(spark: SparkSession, sf: str) -> DataFrame:
    """Words as they are, since SQL has no stems; tests hold stems against a plain search."""
    return fulltext.matches(spark, _index(spark, sf, False), "of the", "doc_id", False).select("doc_id", F.round("rank", 6).alias("rank"))


@query("f10_stemmed_text")
def f10_stems(spark: SparkSession, sf: str) -> DataFrame:
    """English lexemes: any form of the words, without stop words."""
    return fulltext.matches(spark, _index(spark, sf, True), "the hands of a thing", "doc_id").select("doc_id", F.round("rank", 6).alias("rank"))


@query("v02_indexed_search", f"""WITH {_QUERY}, {_WORDS}, c AS (SELECT e.vec_id, {_COSINE} AS cosine FROM embeddings e, q WHERE {_COSINE} > 0 ORDER BY cosine DESC, e.vec_id LIMIT 60),
    k AS (SELECT a.doc_id, 1 - exp(sum({_PAIR})) AS rank FROM p a JOIN p b ON a.doc_id = b.doc_id AND a.lexeme = 'the' AND b.lexeme = 'of' WHERE a.doc_id IN (SELECT vec_id FROM c) GROUP BY 1),
    s AS (SELECT c.vec_id, coalesce(0.7 * c.cosine + 0.3 * k.rank, c.cosine) AS s FROM c JOIN documents d ON d.doc_id = c.vec_id LEFT JOIN k ON k.doc_id = c.vec_id) SELECT vec_id AS chunk_id, round(s, 6) AS similarity FROM s ORDER BY s DESC, chunk_id LIMIT 20""")
def v02_indexed(spark: SparkSession, sf: str) -> DataFrame:
    """Hybrid search whose text share comes from the stored index, looked up for the candidates alone."""
    own, wanted = chunks(spark, sf), question(spark, sf)
    near = retrieval.candidates(own, wanted, 0.0, 20).select(F.col("chunk_id").alias("doc_id"))
    ranks = fulltext.matches(spark, _index(spark, sf, False), "the of", "doc_id", False, near).withColumnRenamed("doc_id", "chunk_id")
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.lit(None).cast("bigint").alias("root_id"))
    hits = retrieval.match_chunks(own.withColumn("content", F.lit("")), docs, wanted, 0.0, 20, ranks=ranks)
    return hits.select("chunk_id", F.round("similarity", 6).alias("similarity"))


@query("v06_named_topics", f"""WITH n AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id IN (0, 1, 2)), t AS (SELECT label AS id, min(vec_id) AS vec_id, count(*) AS chunk_count FROM embeddings GROUP BY label),
    p AS (SELECT 'topic ' || n.vec_id AS asked, t.id, t.chunk_count, (n.vec_id = t.id)::INTEGER AS same, list_dot_product(e.embedding::DOUBLE[], n.v) / (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(n.v, n.v))) AS s FROM t JOIN embeddings e ON e.vec_id = t.vec_id, n),
    c AS (SELECT *, row_number() OVER (PARTITION BY asked ORDER BY same DESC, s DESC, id) AS place FROM p WHERE s > 0.1 OR same = 1), k AS (SELECT * FROM c WHERE place <= 5 AND (s > 0.2 OR same = 1)), i AS (SELECT DISTINCT id, chunk_count FROM k)
    SELECT (SELECT string_agg(id::VARCHAR, ',' ORDER BY id) FROM i) AS topic_ids, (SELECT CAST(sum(chunk_count) AS BIGINT) FROM i) AS chunks, 'filter' AS decision, false AS loosened""")
def v06(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    topics = e.groupBy(F.col("label").alias("id")).agg(F.min_by("embedding", "vec_id").alias("embedding"), F.count("*").alias("chunk_count")).withColumn("name", F.concat(F.lit("Topic "), F.col("id").cast("string")))
    names = e.filter("vec_id IN (0, 1, 2)").select(F.concat(F.lit("topic "), F.col("vec_id").cast("string")).alias("name"), "embedding")
    out = retrieval.topic_names_filter(names, topics, question(spark, sf), 0.2, 0.1)
    return out.select(F.array_join(F.col("topic_ids").cast("array<string>"), ",").alias("topic_ids"), F.col("chunks").cast("bigint").alias("chunks"), "decision", "loosened")


@query("t46_incident_summary", f"""{_NEAR}, h AS (SELECT vec_id, row_number() OVER (ORDER BY s DESC, vec_id) AS rank FROM n QUALIFY rank <= 30), g AS (SELECT coalesce(nullif(d.source, ''), 'unknown') AS incident, count(*) AS hits, min(rank) AS first_rank, arg_min(d.lang, rank) AS subject FROM h JOIN documents d ON d.doc_id = h.vec_id GROUP BY 1),
    o AS (SELECT *, row_number() OVER (ORDER BY first_rank, incident) AS i FROM g) SELECT chr(10) || '---' || chr(10) || chr(10) || '## Incident Summary' || chr(10) || 'Found ' || CAST(sum(hits) AS BIGINT) || ' relevant chunks from ' || count(*) || ' unique incident(s).' || chr(10) ||
    string_agg(chr(10) || '**Incident ' || i || ':** ' || coalesce(nullif(subject, ''), 'Unknown Subject') || chr(10) || '  - Date: Unknown Date' || chr(10) || '  - Relevant sections: ' || hits || chr(10), '' ORDER BY i) AS summary FROM o""")
def t46(spark: SparkSession, sf: str) -> DataFrame:
    near = table(spark, sf, "embeddings").select("vec_id", retrieval.vectors.cosine(F.col("embedding"), question(spark, sf)).alias("s")).orderBy(F.desc("s"), "vec_id").limit(30)
    ranked = near.withColumn("rank", F.row_number().over(retrieval.Window.partitionBy().orderBy(F.desc("s"), "vec_id")))
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), "source", F.col("lang").alias("subject"))
    return retrieval.incident_summary(retrieval.by_incident(ranked.join(d, "vec_id"), ["source"]).withColumn("date", F.lit(None).cast("string")))


@query("d19_topics_checked", "SELECT l_orderkey, l_linenumber, (l_linenumber = 4 OR l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')) AS topics_checked FROM lineitem")
def d19(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_linenumber") == 4).alias("topics_checked"))
    done = table(spark, sf, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return dml.mark_checked(rows, done, "l_orderkey").select("l_orderkey", "l_linenumber", "topics_checked")


@query("q28_orphan_folders", "SELECT 'orphan_folder' AS \"check\", f AS key, CAST(NULL AS VARCHAR) AS detail FROM (SELECT DISTINCT substr(sha256('folder:' || o_custkey), 1, 32) AS f FROM orders) WHERE f NOT IN (SELECT substr(sha256('folder:' || c_custkey), 1, 32) FROM customer WHERE c_acctbal > 0)")
def q28(spark: SparkSession, sf: str) -> DataFrame:
    folders = table(spark, sf, "orders").select(ids.folder_id(F.col("o_custkey")).alias("folder"))
    roots = table(spark, sf, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("doc_id"), F.lit(0).alias("depth"))
    return quality.orphan_folders(folders, roots, ids.folder_id(F.col("doc_id")))


@query("u04_updated_at", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 OR o_orderstatus = 'P' THEN TIMESTAMP '2025-01-01' ELSE o_orderdate END AS updated_at FROM orders")
def u04(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", F.col("o_orderdate").alias("updated_at"))
    changed = o.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return dml.stamped(changed, o.filter("o_orderstatus <> 'P'"), ["o_orderkey"], F.lit("2025-01-01").cast(o.schema["updated_at"].dataType)).select("o_orderkey", "updated_at")


@query("s23_id_remap", "SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 4 = 0 THEN 'kept-' ELSE 'new-' END || l_orderkey AS document_id FROM lineitem")
def s23(spark: SparkSession, sf: str) -> DataFrame:
    o, li = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    fresh = F.concat(F.lit("new-"), F.col("o_orderkey").cast("string"))
    docs = o.select(F.col("o_orderkey").cast("string").alias("doc_id"), fresh.alias("id"), fresh.alias("root_id"))
    stored = o.filter("o_orderkey % 4 = 0").select(F.col("o_orderkey").cast("string").alias("doc_id"), F.concat(F.lit("kept-"), F.col("o_orderkey").cast("string")).alias("id"))
    rows = li.select("l_orderkey", "l_linenumber", F.concat(F.lit("new-"), F.col("l_orderkey").cast("string")).alias("document_id"))
    return dml.with_fresh_ids(docs, rows, stored)[1]


@query("t41_unknown_names", "WITH c AS (SELECT DISTINCT upper(p_type) AS candidate FROM part), t AS (SELECT DISTINCT lower(split_part(p_type, ' ', 1)) AS term FROM part WHERE p_type LIKE 'S%') SELECT candidate FROM c WHERE NOT EXISTS (SELECT 1 FROM t WHERE lower(candidate) = term OR starts_with(lower(candidate), term || ' '))")
def t41(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    terms = p.filter("p_type LIKE 'S%'").select(F.lower(F.split("p_type", " ")[0]).alias("term"))
    return entities.unknown(p.select(F.upper("p_type").alias("candidate")).distinct(), terms)


@query("f17_document_type", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'attachment_pdf' WHEN 1 THEN 'attachment_image' WHEN 2 THEN 'attachment_other' ELSE 'attachment_csv' END AS kind FROM documents")
def f17(spark: SparkSession, sf: str) -> DataFrame:
    mimes = F.array(*[F.lit(m) for m in ("application/pdf", "image/png", "application/x-unheard-of", "text/csv")])
    return table(spark, sf, "documents").select("doc_id", txt.document_type(F.get(mimes, (F.col("doc_id") % 4).cast("int"))).alias("kind"))


@query("q09_root_not_email", "SELECT 'root_not_email' AS \"check\", l_orderkey || '-' || l_linenumber AS key, CAST(l_orderkey AS VARCHAR) AS detail FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'F'")
def q09(spark: SparkSession, sf: str) -> DataFrame:
    o, li = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    root = o.select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderkey").cast("string").alias("root_id"), F.when(F.col("o_orderstatus") == "F", "email").otherwise("email_draft").alias("document_type"))
    leaf = li.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), F.col("l_orderkey").cast("string").alias("root_id"), F.lit("attachment_pdf").alias("document_type"))
    return quality.root_not_email(root.filter("document_type = 'email'").unionByName(leaf))


@query("q24_schema_parity", "SELECT 'orders' AS name, 'o_ghost' AS missing, 'o_orderpriority' AS extra")
def q24(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    missing, extra = diff.missing_columns(o, [*[c for c in o.columns if c != "o_orderpriority"], "o_ghost"])
    return spark.createDataFrame([("orders", ",".join(missing), ",".join(extra))], "name string, missing string, extra string")


#: The references among the relational tables.
_EDGES = [
    keygraph.Edge("nation", "n_regionkey", "region", "r_regionkey"), keygraph.Edge("customer", "c_nationkey", "nation", "n_nationkey"), keygraph.Edge("supplier", "s_nationkey", "nation", "n_nationkey"),
    keygraph.Edge("orders", "o_custkey", "customer", "c_custkey"), keygraph.Edge("lineitem", "l_orderkey", "orders", "o_orderkey"), keygraph.Edge("lineitem", "l_suppkey", "supplier", "s_suppkey"),
]
_KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "orders": "o_orderkey", "lineitem": "l_orderkey"}


@query("q23_orphans_by_reference", """SELECT 'nation' AS child, 'n_regionkey' AS "column", 'region' AS parent, count(*) AS orphans FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region WHERE r_regionkey <> 3)
    UNION ALL SELECT 'customer', 'c_nationkey', 'nation', count(*) FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation) UNION ALL SELECT 'supplier', 's_nationkey', 'nation', count(*) FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation)
    UNION ALL SELECT 'orders', 'o_custkey', 'customer', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'lineitem', 'l_orderkey', 'orders', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 10 <> 4)
    UNION ALL SELECT 'lineitem', 'l_suppkey', 'supplier', count(*) FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier)""")
def q23(spark: SparkSession, sf: str) -> DataFrame:
    """Every reference of the key graph, on tables that have lost a region and some orders."""
    tables = {name: table(spark, sf, name) for name in _KEYS}
    tables |= {"region": tables["region"].filter("r_regionkey <> 3"), "orders": tables["orders"].filter("o_orderkey % 10 <> 4")}
    return keygraph.orphans(tables, _EDGES)


@query("d15_wipe", """SELECT 0 AS layer, 'lineitem' AS name, count(*) AS rows FROM lineitem UNION ALL SELECT 1, 'orders', count(*) FROM orders UNION ALL SELECT 1, 'supplier', count(*) FROM supplier
    UNION ALL SELECT 2, 'customer', count(*) FROM customer UNION ALL SELECT 3, 'nation', count(*) FROM nation UNION ALL SELECT 4, 'region', count(*) FROM region""")
def d15(spark: SparkSession, sf: str) -> DataFrame:
    """A wipe that is interrupted and taken up again: rows gone by layer of the key graph and table."""
    library = keygraph.Library(spark, f"{scratch_dir(spark)}/dossier-library-{uuid.uuid4().hex}", _KEYS, _EDGES, ranges=2)
    library.store({name: table(spark, sf, name) for name in _KEYS})
    library.wipe(most_steps=5)
    library.wipe()
    return library.progress().groupBy("layer", "name").agg(F.sum("rows").alias("rows"))
