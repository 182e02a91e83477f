"""Retrieval, topics, entities and evaluation on the driver's tables.

embeddings stand for chunk vectors (vec_id = doc_id), label for a topic, the vector of id 0 for the question.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dossier.functions import vectors
from dossier.operators import diff, entities, evals, retrieval, topics
from dossier.plans.registry import query, table

_COSINE = "list_dot_product(e.embedding::DOUBLE[], q.v) / (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(q.v, q.v)))"
_QUERY = "q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0)"


def question(spark: SparkSession, sf: str, vec_id: int = 0) -> Column:
    """The question's vector as a literal: one row of a bounded lookup."""
    rows = table(spark, sf, "embeddings").filter(F.col("vec_id") == vec_id).select("embedding").limit(1).collect()
    return vectors.literal(rows[0][0])


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("chunk_id"), F.col("vec_id").alias("document_id"), "embedding", F.array(F.col("label"), F.col("label") + 10).alias("topic_ids"), F.array(F.col("vec_id") % 3).alias("kinds")
    )


@query("v01_cosine", f"WITH {_QUERY} SELECT e.vec_id, round({_COSINE}, 6) AS similarity FROM embeddings e, q")
def v01(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", F.round(vectors.cosine(F.col("embedding"), question(spark, sf)), 6).alias("similarity"))


@query("k01_vector_top_k", f"WITH {_QUERY} SELECT e.vec_id AS chunk_id, round({_COSINE}, 6) AS cosine FROM embeddings e, q WHERE {_COSINE} > 0.1 ORDER BY {_COSINE} DESC, e.vec_id LIMIT 60")
def k01(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.candidates(chunks(spark, sf), question(spark, sf), 0.1, 10).select("chunk_id", F.round("cosine", 6).alias("cosine"))


@query("v02_hybrid_search", f"""WITH {_QUERY}, c AS (SELECT e.vec_id, {_COSINE} AS cosine FROM embeddings e, q WHERE e.embedding IS NOT NULL AND {_COSINE} > 0 AND (label IN (0, 1, 2, 3) OR label + 10 IN (0, 1, 2, 3)) ORDER BY cosine DESC, e.vec_id LIMIT 60),
    t AS (SELECT c.vec_id, c.cosine, d.lang, d.source, regexp_extract_all(lower(coalesce(d.text, '')), '[a-z0-9]+') AS w, d.doc_id - d.doc_id % 10 AS root_id FROM c JOIN documents d ON d.doc_id = c.vec_id),
    s AS (SELECT vec_id AS chunk_id, CASE WHEN list_contains(w, 'the') THEN 0.7 * cosine + 0.3 * least(1.0, len(list_filter(w, lambda x: x = 'the'))::DOUBLE / len(w)) ELSE cosine END AS similarity, root_id, lang FROM t)
    SELECT chunk_id, round(similarity, 6) AS similarity, r.doc_id AS root_uuid, coalesce(CASE WHEN s.lang <> 'en' THEN s.lang END, CASE WHEN r.lang <> 'en' THEN r.lang END) AS subject FROM s LEFT JOIN documents r ON r.doc_id = s.root_id ORDER BY s.similarity DESC, chunk_id LIMIT 10""")
def v02(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    docs = d.select(F.col("doc_id").alias("id"), (F.col("doc_id") - F.col("doc_id") % 10).alias("root_id"), F.when(F.col("lang") != "en", F.col("lang")).alias("subject"))
    found = retrieval.candidates(chunks(spark, sf), question(spark, sf), 0.0, 10, retrieval.contains_any(F.col("topic_ids"), [0, 1, 2, 3]))
    texts = found.join(d.select(F.col("doc_id").alias("document_id"), F.coalesce("text", F.lit("")).alias("content")), "document_id")
    score = F.when(retrieval.matches_text(F.col("content"), "the"), retrieval.VECTOR_SHARE * F.col("cosine") + retrieval.TEXT_SHARE * retrieval.text_score(F.col("content"), "the")).otherwise(F.col("cosine"))
    scored = texts.select("chunk_id", "document_id", score.alias("similarity"))
    own, root = docs.alias("d"), docs.alias("r")
    joined = scored.join(own, F.col("document_id") == F.col("d.id")).join(root, F.col("d.root_id") == F.col("r.id"), "left")
    return joined.orderBy(F.desc("similarity"), "chunk_id").limit(10).select("chunk_id", F.round("similarity", 6).alias("similarity"), F.col("r.id").alias("root_uuid"), F.coalesce("d.subject", "r.subject").alias("subject"))


@query("v02_match_chunks", f"""WITH {_QUERY}, c AS (SELECT e.vec_id, {_COSINE} AS cosine FROM embeddings e, q WHERE {_COSINE} > 0 AND e.vec_id % 3 = 1 ORDER BY cosine DESC, e.vec_id LIMIT 60)
    SELECT c.vec_id AS chunk_id, round(c.cosine, 6) AS similarity, d.source FROM c JOIN documents d ON d.doc_id = c.vec_id ORDER BY c.cosine DESC, c.vec_id LIMIT 15""")
def v02_match(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.lit(None).cast("bigint").alias("root_id"), "source")
    hits = retrieval.match_chunks(chunks(spark, sf).withColumn("content", F.lit("")), docs, question(spark, sf), 0.0, 15, other={"kinds": [1]}, inherited=("source",))
    return hits.select("chunk_id", F.round("similarity", 6).alias("similarity"), "source")


@query("f03_contains_all", "SELECT vec_id FROM embeddings WHERE list_has_all([label, label + 10], [2, 12])")
def f03(spark: SparkSession, sf: str) -> DataFrame:
    return chunks(spark, sf).filter(retrieval.contains_all(F.col("topic_ids"), [2, 12])).select(F.col("chunk_id").alias("vec_id"))


@query("f04_contains_any", "SELECT vec_id FROM embeddings WHERE list_has_any([label, label + 10], [1, 13])")
def f04(spark: SparkSession, sf: str) -> DataFrame:
    return chunks(spark, sf).filter(retrieval.contains_any(F.col("topic_ids"), [1, 13])).select(F.col("chunk_id").alias("vec_id"))


@query("f05_key_set", "SELECT vec_id, label + 1 AS topic, vec_id % 2 = 0 AS checked FROM embeddings WHERE label IS NOT NULL")
def f05(spark: SparkSession, sf: str) -> DataFrame:
    meta = F.struct(F.col("label").alias("topic"), F.lit(False).alias("topics_checked"), F.lit("x").alias("gone"))
    e = table(spark, sf, "embeddings").withColumn("metadata", meta).filter("metadata.topic is not null")
    changed = F.col("metadata").dropFields("gone").withField("topic", F.col("metadata.topic") + 1).withField("topics_checked", F.col("vec_id") % 2 == 0)
    return e.withColumn("metadata", changed).select("vec_id", "metadata.topic", F.col("metadata.topics_checked").alias("checked"))


@query("f10_full_text", "SELECT doc_id FROM documents WHERE list_has_all(regexp_extract_all(lower(text), '[a-z0-9]+'), ['the', 'and', 'with'])")
def f10(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").filter(retrieval.matches_text(F.col("text"), "the and with")).select("doc_id")


@query("a02_multi_topic_count", "SELECT count(DISTINCT vec_id) AS n FROM embeddings WHERE list_has_any([label, label + 10], [0, 2, 11])")
def a02(spark: SparkSession, sf: str) -> DataFrame:
    return chunks(spark, sf).filter(retrieval.contains_any(F.col("topic_ids"), [0, 2, 11])).agg(F.count_distinct("chunk_id").alias("n"))


@query("k02_similar_topics", f"""WITH {_QUERY}, n AS (SELECT e.vec_id AS id, {_COSINE} AS s FROM embeddings e, q ORDER BY s DESC, id LIMIT 20) SELECT id, round(s, 6) AS similarity FROM n WHERE s > 0.2 ORDER BY s DESC, id LIMIT 5""")
def k02(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.lit("t").alias("name"), "embedding")
    return retrieval.similar_topics(t, question(spark, sf), 0.2, 5).select("id", F.round("similarity", 6).alias("similarity"))


@query("k03_similar_excluding", f"""WITH {_QUERY}, n AS (SELECT e.vec_id AS id, {_COSINE} AS s FROM embeddings e, q WHERE e.vec_id NOT IN (0, 4, 8) ORDER BY s DESC, id LIMIT 28) SELECT id, round(s, 6) AS similarity FROM n WHERE s > 0 ORDER BY s DESC, id LIMIT 7""")
def k03(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.lit("t").alias("name"), "embedding")
    return retrieval.similar_topics(t, question(spark, sf), 0.0, 7, [0, 4, 8]).select("id", F.round("similarity", 6).alias("similarity"))


@query("k04_cluster_top_k", f"""WITH {_QUERY}, r AS (SELECT e.label, e.vec_id, CASE WHEN e.vec_id % 50 = 0 THEN 0 ELSE 1 END AS o, {_COSINE} AS s FROM embeddings e, q),
    n AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY o, s DESC, vec_id) AS k FROM r) SELECT label, vec_id, k AS place FROM n WHERE k <= 3""")
def k04(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    scored = e.select("label", "vec_id", F.when(F.col("vec_id") % 50 == 0, 0).otherwise(1).alias("o"), vectors.cosine(F.col("embedding"), question(spark, sf)).alias("s"))
    place = F.row_number().over(Window.partitionBy("label").orderBy("o", F.desc("s"), "vec_id")).cast("bigint")
    return scored.withColumn("place", place).filter("place <= 3").select("label", "vec_id", "place")


@query("f19_rerank", f"""WITH {_QUERY}, c AS (SELECT e.vec_id, {_COSINE} AS s FROM embeddings e, q ORDER BY s DESC, vec_id LIMIT 60), r AS (SELECT vec_id, (vec_id * 7919 % 101) / 100.0::DOUBLE AS rr, row_number() OVER (ORDER BY (vec_id * 7919 % 101) / 100.0::DOUBLE DESC, vec_id) AS n FROM c)
    SELECT vec_id AS chunk_id, rr AS rerank_score, n AS rank FROM r WHERE n <= 10 AND (rr >= 0.9 OR n = 1)""")
def f19(spark: SparkSession, sf: str) -> DataFrame:
    hits = retrieval.candidates(chunks(spark, sf), question(spark, sf), -1.0, 20)
    out = retrieval.rerank(hits, (F.col("chunk_id") * 7919 % 101) / 100.0, 10, 0.9)
    return out.select("chunk_id", "rerank_score", F.col("rank").cast("bigint").alias("rank"))


@query("v07_fallback", f"""WITH {_QUERY}, c AS (SELECT e.vec_id, {_COSINE} AS s FROM embeddings e, q WHERE label = 99999 ORDER BY s DESC LIMIT 60), u AS (SELECT e.vec_id, {_COSINE} AS s FROM embeddings e, q WHERE {_COSINE} > 0 ORDER BY s DESC, vec_id LIMIT 60)
    SELECT vec_id AS chunk_id, false AS topic_filter_used FROM (SELECT * FROM u ORDER BY s DESC, vec_id LIMIT 20)""")
def v07(spark: SparkSession, sf: str) -> DataFrame:
    q, all_chunks = question(spark, sf), chunks(spark, sf)
    top = lambda where: retrieval.candidates(all_chunks, q, 0.0, 20, where).orderBy(F.desc("cosine"), "chunk_id").limit(20).select("chunk_id")
    return retrieval.fall_back(top(retrieval.contains_any(F.col("topic_ids"), [99999])), top(None), 20)


@query("a11_incidents", f"""WITH {_QUERY}, c AS (SELECT e.vec_id, row_number() OVER (ORDER BY {_COSINE} DESC, vec_id) AS rank FROM embeddings e, q), h AS (SELECT c.rank, coalesce(CASE WHEN d.doc_id % 5 = 0 THEN NULL ELSE d.source END, 'unknown') AS incident, d.lang FROM c JOIN documents d ON d.doc_id = c.vec_id WHERE c.rank <= 40)
    SELECT incident, count(*) AS hits, min(rank) AS first_rank, min_by(lang, rank) AS subject FROM h GROUP BY incident""")
def a11(spark: SparkSession, sf: str) -> DataFrame:
    near = table(spark, sf, "embeddings").select("vec_id", vectors.cosine(F.col("embedding"), question(spark, sf)).alias("s")).orderBy(F.desc("s"), "vec_id").limit(40)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy().orderBy(F.desc("s"), "vec_id")).cast("bigint"))
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), F.when(F.col("doc_id") % 5 != 0, F.col("source")).alias("source"), F.col("lang").alias("subject"))
    return retrieval.by_incident(ranked.join(d, "vec_id"), ["source"])


@query("v08_envelope", f"""WITH {_QUERY}, c AS (SELECT e.vec_id, row_number() OVER (ORDER BY {_COSINE} DESC, vec_id) AS rank FROM embeddings e, q), h AS (SELECT c.rank, d.* FROM c JOIN documents d ON d.doc_id = c.vec_id WHERE c.rank <= 30)
    SELECT string_agg('[CITE:' || doc_id || ' | title:"' || source || '"]' || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context, string_agg(doc_id::VARCHAR, ',' ORDER BY rank) AS ids, CAST(count(*) AS INTEGER) AS count FROM h""")
def v08(spark: SparkSession, sf: str) -> DataFrame:
    near = table(spark, sf, "embeddings").select("vec_id", vectors.cosine(F.col("embedding"), question(spark, sf)).alias("s")).orderBy(F.desc("s"), "vec_id").limit(30)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy().orderBy(F.desc("s"), "vec_id")))
    hits = ranked.join(table(spark, sf, "documents"), F.col("vec_id") == F.col("doc_id"))
    none = F.lit(None).cast("string")
    block = retrieval.context_block(F.col("source"), none, F.col("doc_id").cast("string"), F.col("text"), none)
    return retrieval.envelope(hits, block, key="doc_id").withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), ","))


def topic_table(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.concat(F.lit("Topic-"), (F.col("vec_id") % 40).cast("string")).alias("name"), "embedding", (F.col("vec_id") * 31 % 17).alias("chunk_count"))


_PAIRS = """SELECT a.vec_id AS a, b.vec_id AS b, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))) AS s
    FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id"""


@query("j13_similar_pairs", f"SELECT a, b, round(s, 6) AS similarity FROM ({_PAIRS}) WHERE s >= 0.4")
def j13(spark: SparkSession, sf: str) -> DataFrame:
    return topics.similar_pairs(topic_table(spark, sf), 0.4).withColumn("similarity", F.round("similarity", 6))


@query("v12_similarity_band", f"SELECT a, b, round(s, 6) AS similarity FROM ({_PAIRS}) WHERE s >= 0.3 AND s < 0.45")
def v12(spark: SparkSession, sf: str) -> DataFrame:
    return topics.similar_pairs(topic_table(spark, sf), 0.3, 0.45).withColumn("similarity", F.round("similarity", 6))


@query("v10_cluster_plan", f"""WITH RECURSIVE p AS (SELECT a, b FROM ({_PAIRS}) WHERE s >= 0.42), e AS (SELECT a, b FROM p UNION SELECT b, a FROM p), r(id, other) AS (SELECT a, a FROM e UNION SELECT r.id, e.b FROM r JOIN e ON r.other = e.a),
    c AS (SELECT id, min(other) AS component FROM r GROUP BY id), k AS (SELECT id, first_value(id) OVER (PARTITION BY component ORDER BY id * 31 % 17 DESC, id) AS keeper FROM c) SELECT id AS absorbed, keeper FROM k WHERE id <> keeper""")
def v10(spark: SparkSession, sf: str) -> DataFrame:
    t = topic_table(spark, sf)
    return topics.cluster_plan(t, topics.similar_links(t, 0.42))


@query("v09_greedy_plan", f"""WITH RECURSIVE p AS (SELECT a, b FROM ({_PAIRS}) WHERE s >= 0.42), w AS (SELECT vec_id AS id, vec_id * 31 % 17 AS w FROM embeddings),
    e AS (SELECT x.a AS over, x.b AS under FROM (SELECT a, b FROM p UNION ALL SELECT b, a FROM p) x JOIN w wa ON wa.id = x.a JOIN w wb ON wb.id = x.b WHERE wa.w > wb.w OR wa.w = wb.w AND x.a < x.b),
    t AS (SELECT e.over AS id, list(e.under) AS under, row_number() OVER (ORDER BY any_value(w.w) DESC, e.over) AS place FROM e JOIN w ON w.id = e.over GROUP BY e.over),
    walk AS (SELECT 0::BIGINT AS place, []::BIGINT[] AS taken, NULL::BIGINT AS keeper, []::BIGINT[] AS fresh
      UNION ALL SELECT place, taken || fresh, keeper, fresh FROM (SELECT t.place, k.taken, t.id AS keeper,
        CASE WHEN list_contains(k.taken, t.id) THEN [] ELSE list_filter(t.under, lambda x: NOT list_contains(k.taken, x)) END AS fresh FROM walk k JOIN t ON t.place = k.place + 1))
    SELECT unnest(fresh) AS absorbed, keeper FROM walk""")
def v09(spark: SparkSession, sf: str) -> DataFrame:
    t = topic_table(spark, sf)
    return topics.greedy_plan(t, topics.similar_pairs(t, 0.42))


@query("v11_name_plan", """WITH t AS (SELECT vec_id AS id, vec_id % 40 AS bucket, vec_id * 31 % 17 AS w FROM embeddings), k AS (SELECT id, first_value(id) OVER (PARTITION BY bucket ORDER BY w DESC, id) AS keeper FROM t) SELECT id AS absorbed, keeper FROM k WHERE id <> keeper""")
def v11(spark: SparkSession, sf: str) -> DataFrame:
    return topics.name_plan(topic_table(spark, sf))


@query("v13_resolve_topics", """WITH p AS (SELECT n.vec_id AS n, t.vec_id AS t, list_dot_product(n.embedding::DOUBLE[], t.embedding::DOUBLE[]) / (sqrt(list_dot_product(n.embedding::DOUBLE[], n.embedding::DOUBLE[])) * sqrt(list_dot_product(t.embedding::DOUBLE[], t.embedding::DOUBLE[]))) AS s
    FROM embeddings n JOIN embeddings t ON n.vec_id % 2 = 1 AND t.vec_id % 2 = 0), b AS (SELECT n, arg_max(t, s) AS t FROM p WHERE s >= 0.4 GROUP BY n), k AS (SELECT vec_id % 40 AS k, min(vec_id) AS id FROM embeddings WHERE vec_id % 2 = 0 GROUP BY 1)
    SELECT 'topic ' || e.vec_id AS name, coalesce(k.id::VARCHAR, b.t::VARCHAR, substr(sha256('topic:topic ' || e.vec_id), 1, 32)) AS topic_id, CASE WHEN k.id IS NOT NULL THEN 'name' WHEN b.t IS NOT NULL THEN 'similar' ELSE 'new' END AS how
    FROM embeddings e LEFT JOIN k ON k.k = e.vec_id LEFT JOIN b ON b.n = e.vec_id WHERE e.vec_id % 2 = 1""")
def v13(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    known = topic_table(spark, sf).filter("id % 2 = 0")  # the odd ones ask
    asked = e.filter("vec_id % 2 = 1").select(F.concat(F.lit("topic "), F.col("vec_id").cast("string")).alias("name"), "embedding")
    return topics.resolve(asked, known, 0.4)


@query("v15_vector_flaws", """WITH e AS (SELECT vec_id, CASE WHEN vec_id % 20 = 7 THEN NULL WHEN vec_id % 20 = 9 THEN list_transform(embedding, lambda x: x * 0) ELSE embedding END AS embedding FROM embeddings)
    SELECT vec_id, 'missing' AS flaw FROM e WHERE embedding IS NULL OR len(embedding) = 0 UNION ALL SELECT vec_id, 'zero' FROM e WHERE len(embedding) > 0 AND list_sum(list_transform(embedding, lambda x: abs(x))) = 0""")
def v15(spark: SparkSession, sf: str) -> DataFrame:
    k, e = F.col("vec_id") % 20, F.col("embedding")
    spoilt = F.when(k == 9, F.transform(e, lambda x: x * F.lit(0).cast("float"))).when(k != 7, e)
    return table(spark, sf, "embeddings").select("vec_id", vectors.flaw(spoilt).alias("flaw")).filter("flaw is not null")


@query("j12_name_mentions", """WITH t AS (SELECT n_nationkey AS id, lower(n_name) AS term FROM nation UNION ALL SELECT r_regionkey + 100, lower(r_name) FROM region UNION ALL SELECT * FROM (VALUES (200, 'the'), (201, 'of the'), (202, 'and the'))),
    w AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), ' ') || ' ' AS s FROM documents) SELECT DISTINCT doc_id, id FROM w JOIN t ON contains(w.s, ' ' || array_to_string(regexp_extract_all(t.term, '[\\p{L}\\p{N}_]+'), ' ') || ' ')""")
def j12(spark: SparkSession, sf: str) -> DataFrame:
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    more = spark.createDataFrame([(200, "the"), (201, "of the"), (202, "and the")], "id int, name string")
    register = n.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")).unionByName(r.select((F.col("r_regionkey") + 100).alias("id"), F.col("r_name").alias("name"))).unionByName(more)
    terms = entities.lookup(register.withColumn("aliases", F.array().cast("array<string>")))
    return entities.mentions(table(spark, sf, "documents"), terms, "doc_id", "text")


@query("j14_fuzzy_names", """WITH a AS (SELECT DISTINCT upper(n_name) || CASE WHEN n_nationkey % 2 = 0 THEN 'X' ELSE '' END AS candidate FROM nation), p AS (SELECT candidate, upper(n_name) AS term, 1.0 - levenshtein(candidate, upper(n_name))::DOUBLE / greatest(length(candidate), length(n_name)) AS ratio FROM a, nation),
    r AS (SELECT *, row_number() OVER (PARTITION BY candidate ORDER BY ratio DESC, term) AS n FROM p WHERE ratio >= 0.8) SELECT candidate, term, round(ratio, 6) AS ratio FROM r WHERE n = 1""")
def j14(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation")
    names = n.select(F.concat(F.upper("n_name"), F.when(F.col("n_nationkey") % 2 == 0, "X").otherwise("")).alias("candidate"))
    return entities.closest(names, n.select(F.upper("n_name").alias("term")), 0.8).withColumn("ratio", F.round("ratio", 6))


@query("j14_name_ratio")
def j14_ratio(spark: SparkSession, sf: str) -> DataFrame:
    """Parts' names, with a letter lost or doubled here and there, against the register of all of them; tests hold it against all pairs."""
    p, name = table(spark, sf, "part"), F.upper("p_name")
    spoilt = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.left(name, F.lit(4)), F.substring(name, 6, 100))).when(F.col("p_partkey") % 3 == 1, F.concat(name, F.right(name, F.lit(1)))).otherwise(F.reverse(name))
    found = entities.closest_by_blocks(p.select(spoilt.alias("candidate")), p.select(name.alias("term")))
    return found.withColumn("ratio", F.round("ratio", 6))


@query("v14_tagging", """WITH t AS (SELECT n_nationkey AS id, lower(n_name) AS term FROM nation UNION ALL SELECT * FROM (VALUES (200, 'the'), (201, 'of the'), (202, 'and the'))),
    w AS (SELECT source, ' ' || array_to_string(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), ' ') || ' ' AS s FROM documents), f AS (SELECT DISTINCT coalesce(source, '') AS root, id FROM w JOIN t ON contains(w.s, ' ' || array_to_string(regexp_extract_all(t.term, '[\\p{L}\\p{N}_]+'), ' ') || ' '))
    SELECT root, string_agg(DISTINCT CAST(id AS VARCHAR), ',' ORDER BY CAST(id AS VARCHAR)) AS found, string_agg(DISTINCT CASE WHEN id < 200 THEN 'nation' ELSE 'phrase' END, ',' ORDER BY CASE WHEN id < 200 THEN 'nation' ELSE 'phrase' END) AS kinds FROM f GROUP BY root""")
def v14(spark: SparkSession, sf: str) -> DataFrame:
    # a source stands for an e-mail tree: the names found in any of its texts tag all of it
    more = spark.createDataFrame([(200, "the", "phrase"), (201, "of the", "phrase"), (202, "and the", "phrase")], "id int, name string, kind string")
    register = table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.lit("nation").alias("kind")).unionByName(more)
    terms = entities.lookup(register.withColumn("aliases", F.array().cast("array<string>")))
    texts = table(spark, sf, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("root"), "text")
    found = entities.mentions(texts, terms, "root", "text")
    out = entities.attributes(found, register, "root", ["kind"])
    return out.select("root", F.array_join(F.array_sort(F.col("ids").cast("array<string>")), ",").alias("found"), F.array_join("kinds", ",").alias("kinds"))


_HITS = """h AS (SELECT doc_id % 20 AS question_id, doc_id AS chunk_id, row_number() OVER (PARTITION BY doc_id % 20 ORDER BY n_chars DESC, doc_id) AS rank FROM documents), g AS (SELECT doc_id % 20 AS question_id, doc_id AS chunk_id FROM labels WHERE quality = 1)"""


@query("a13_retrieval_metrics", f"""WITH {_HITS}, n AS (SELECT question_id, count(*) AS r FROM g GROUP BY 1), m AS (SELECT h.question_id, h.rank FROM h JOIN g ON h.question_id = g.question_id AND h.chunk_id = g.chunk_id),
    a AS (SELECT question_id, count(*) FILTER (WHERE rank <= 5) AS h5, count(*) FILTER (WHERE rank <= 10) AS h10, count(*) FILTER (WHERE rank <= 20) AS h20, min(rank) FILTER (WHERE rank <= 20) AS f, sum(1.0 / log2(rank + 1)) FILTER (WHERE rank <= 10) AS dcg FROM m GROUP BY 1)
    SELECT n.question_id, round(coalesce(h5::DOUBLE / r, 0), 6) AS recall_at_5, round(coalesce(h10::DOUBLE / r, 0), 6) AS recall_at_10, round(coalesce(h20::DOUBLE / r, 0), 6) AS recall_at_20, round(coalesce(1.0::DOUBLE / f, 0), 6) AS mrr,
    round(coalesce(dcg / (SELECT sum(1.0 / log2(i + 1)) FROM range(1, least(r, 10) + 1) t(i)), 0), 6) AS ndcg_at_10 FROM n LEFT JOIN a ON n.question_id = a.question_id""")
def a13(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select((F.col("doc_id") % 20).alias("question_id"), F.col("doc_id").alias("chunk_id"), "n_chars")
    hits = d.withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("n_chars"), "chunk_id")))
    good = table(spark, sf, "labels").filter("quality = 1").select((F.col("doc_id") % 20).alias("question_id"), F.col("doc_id").alias("chunk_id"))
    out = evals.ranked_metrics(hits, good)
    return out.select("question_id", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


@query("a12_score_summary", """WITH s AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL),
    j AS (SELECT *, greatest(1, least((n + 1) // 10, n - 1)) AS j FROM s) SELECT event_type, count(*) AS scored, round(avg(value), 4) AS mean, round(quantile_cont(value, 0.5), 4) AS p50,
    round(CASE WHEN max(n) >= 10 THEN (max(CASE WHEN i = j THEN value END) * (10 - ((max(n) + 1) - max(j) * 10)) + max(CASE WHEN i = j + 1 THEN value END) * ((max(n) + 1) - max(j) * 10)) / 10 ELSE min(value) END, 4) AS p10 FROM j GROUP BY event_type""")
def a12(spark: SparkSession, sf: str) -> DataFrame:
    return evals.summary(table(spark, sf, "events").filter("value is not null"), "value", ["event_type"])


@query("a14_citation_totals", """WITH f AS (SELECT o_custkey AS question_id, o_orderkey % 40 AS chunk_id, o_orderkey AS p FROM orders), v AS (SELECT DISTINCT question_id, chunk_id, chunk_id % 4 <> 0 AS valid FROM f)
    SELECT n.question_id, n.n_found, coalesce(c.n_valid, 0) AS n_valid, coalesce(c.n_invalid, 0) AS n_invalid, coalesce(c.n_invalid::DOUBLE / n.n_found > 0.5, false) AS needs_retry FROM (SELECT question_id, CAST(count(*) AS INTEGER) AS n_found FROM f GROUP BY 1) n
    LEFT JOIN (SELECT question_id, count(*) FILTER (WHERE valid) AS n_valid, count(*) FILTER (WHERE NOT valid) AS n_invalid FROM v GROUP BY 1) c ON n.question_id = c.question_id""")
def a14(spark: SparkSession, sf: str) -> DataFrame:
    identifier = lambda c: F.lpad(c.cast("string"), 12, "0")
    o = table(spark, sf, "orders").withColumn("cited", identifier(F.col("o_orderkey") % 40))
    answers = o.groupBy(F.col("o_custkey").alias("question_id")).agg(F.collect_list("cited").alias("found"))
    known = o.filter(F.col("o_orderkey") % 40 % 4 != 0).select(F.col("o_custkey").alias("question_id"), F.col("cited").alias("chunk_id")).distinct()
    checked = evals.validate_citations(answers, known, F.col("found"))
    return evals.citation_totals(answers, checked, F.col("found"))


@query("a21_grid_sweep", f"""WITH {_QUERY}, s AS (SELECT e.label AS question_id, e.vec_id AS item, {_COSINE} AS similarity FROM embeddings e, q), r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY similarity DESC, item) AS n FROM s), g AS (SELECT * FROM (VALUES (0.1), (0.2), (0.4)) t(threshold), (VALUES (1), (3), (5)) k(k)),
    m AS (SELECT threshold, k, question_id, count(*) AS m FROM r JOIN g ON similarity >= threshold AND n <= k GROUP BY 1, 2, 3), c AS (SELECT count(DISTINCT question_id) AS n FROM s) SELECT g.threshold::DOUBLE AS threshold, g.k, round(coalesce(count(m.m)::DOUBLE / max(c.n), 0), 6) AS match_rate, round(coalesce(sum(m.m)::DOUBLE / max(c.n), 0), 6) AS items_per_question
    FROM g CROSS JOIN c LEFT JOIN m ON m.threshold = g.threshold AND m.k = g.k GROUP BY g.threshold, g.k""")
def a21(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "embeddings").select(F.col("label").alias("question_id"), F.col("vec_id").alias("item"), vectors.cosine(F.col("embedding"), question(spark, sf)).alias("similarity"))
    out = evals.grid_sweep(s, spark.createDataFrame([(0.1,), (0.2,), (0.4,)], "threshold double"), spark.createDataFrame([(1,), (3,), (5,)], "k int"))
    return out.select("threshold", "k", F.round("match_rate", 6).alias("match_rate"), F.round("items_per_question", 6).alias("items_per_question"))


_RUNS = "a AS (SELECT p_partkey AS q, p_retailprice / 1000 AS s FROM part WHERE p_partkey % 9 <> 0), b AS (SELECT p_partkey AS q, p_retailprice / 1000 + (p_size % 7 - 3) / 100.0::DOUBLE AS s FROM part WHERE p_partkey % 8 <> 0)"


def _runs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    p = table(spark, sf, "part")
    a = p.filter("p_partkey % 9 <> 0").select(F.col("p_partkey").alias("q"), (F.col("p_retailprice") / 1000).alias("s"))
    return a, p.filter("p_partkey % 8 <> 0").select(F.col("p_partkey").alias("q"), (F.col("p_retailprice") / 1000 + (F.col("p_size") % 7 - 3) / 100.0).alias("s"))


@query("k10_regressions", f"WITH {_RUNS} SELECT a.q, round(b.s - a.s, 6) AS delta FROM a JOIN b ON a.q = b.q WHERE b.s - a.s < -0.001 ORDER BY round(b.s - a.s, 6), a.q LIMIT 20")
def k10(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _runs(spark, sf)
    exact = lambda df: df.withColumn("s", F.col("s").cast("decimal(18,6)"))
    return diff.run_changes(exact(a), exact(b), "q", "s")[0].select("q", F.col("delta").cast("double").alias("delta"))


@query("j18_run_comparison", f"WITH {_RUNS} SELECT 'both' AS side, count(*) AS n FROM a JOIN b ON a.q = b.q UNION ALL SELECT 'before', count(*) FROM a WHERE q NOT IN (SELECT q FROM b) UNION ALL SELECT 'after', count(*) FROM b WHERE q NOT IN (SELECT q FROM a)")
def j18(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _runs(spark, sf)
    _, _, gone, new = diff.run_changes(a, b, "q", "s")
    n = lambda side, df: df.agg(F.count("*").alias("n")).select(F.lit(side).alias("side"), "n")
    return n("both", a.join(b.select("q"), "q")).unionByName(n("before", gone)).unionByName(n("after", new))


@query("t35_overall_score", "SELECT doc_id, CASE WHEN toxic = 1 THEN 1.0::DOUBLE ELSE round(0.65 * quality + 0.35 * (doc_id % 10) / 10.0, 4)::DOUBLE END AS overall FROM labels")
def t35(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "labels").select("doc_id", evals.overall(F.col("quality"), (F.col("doc_id") % 10) / 10.0, F.col("toxic") == 1).alias("overall"))


@query("t34_format_rules", """SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN role = 'assistant' AND (NOT contains(text, 'the') OR contains(text, 'Based on your query') AND NOT contains(text, 'Component:') AND NOT contains(text, 'Most Relevant Solution')) THEN 'missing Component header' END, CASE WHEN length(text) > 400 AND role <> 'assistant' THEN 'no citations despite long response' END], lambda x: x IS NOT NULL), '; ') AS violations FROM conversations""")
def t34(spark: SparkSession, sf: str) -> DataFrame:
    rules = evals.format_violations(F.col("text"), F.col("role") == "assistant", F.lit(False), F.lit(False), ["the"])
    return table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(rules, "; ").alias("violations"))
