"""Joins, aggregates, windows, top-k and changes of tables, on the driver's tables.

customer -> orders -> lineitem stands for a document tree, lineitem(l_orderkey, l_partkey) for the bridge of chunks and
topics, part for topics, and events for the event log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dossier.functions import text as txt
from dossier.operators import diff, dml, evals, windows
from dossier.operators.ingest import wave, with_hierarchy
from dossier.operators.quality import embedding_dimensions, outdated
from dossier.operators.topics import recount
from dossier.plans.registry import query, table


@query("f01_projection", "SELECT vec_id, label FROM embeddings")
def f01(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", "label")


@query("f02_point_filters", """SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders
    WHERE o_orderstatus IN ('F', 'O') AND o_orderpriority <> '5-LOW' AND o_totalprice >= 1000 AND o_custkey IS NOT NULL""")
def f02(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    keep = F.col("o_orderstatus").isin("F", "O") & (F.col("o_orderpriority") != "5-LOW") & (F.col("o_totalprice") >= 1000) & F.col("o_custkey").isNotNull()
    return o.filter(keep).select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("f06_conditional_set", """SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size END AS entity_ids,
    CASE WHEN p_size % 3 = 0 THEN p_type ELSE p_brand END AS entity_types FROM part""")
def f06(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select("p_partkey", "p_size", "p_brand", F.array("p_type").alias("entity_types"), F.array("p_type").alias("entity_classes"))
    empty = F.col("p_size") % 3 == 0
    new = lambda c: F.when(empty, F.array().cast("array<string>")).otherwise(F.array(c))
    out = dml.retagged(p, F.when(empty, F.array().cast("array<int>")).otherwise(F.array("p_size")), new("p_brand"), new("p_brand"))
    return out.select("p_partkey", F.get("entity_ids", F.lit(0)).alias("entity_ids"), F.get("entity_types", F.lit(0)).alias("entity_types"))


@query("f07_inherited_attributes", """SELECT o.o_orderkey, COALESCE(CASE WHEN o.o_orderkey % 2 = 0 THEN o.o_orderpriority END, c.c_mktsegment) AS subject
    FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey""")
def f07(spark: SparkSession, sf: str) -> DataFrame:
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    own = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority"))
    return o.join(c, o.o_custkey == c.c_custkey, "left").select("o_orderkey", F.coalesce(own, "c_mktsegment").alias("subject"))


@query("f09_substring_search", "SELECT p_partkey, p_name FROM part WHERE lower(p_name) LIKE '%an%' AND p_size >= 10")
def f09(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").filter(F.contains(F.lower("p_name"), F.lit("an")) & (F.col("p_size") >= 10)).select("p_partkey", "p_name")


@query("f11_unambiguous_filter", """WITH named AS (SELECT DISTINCT p_brand AS value, 'class' AS kind FROM part UNION SELECT DISTINCT p_type, 'type' FROM part),
    hit AS (SELECT kind, value FROM named WHERE length(value) >= 3 AND regexp_matches('show ' || (SELECT min(p_brand) FROM part) || ' repairs', '(^|[^A-Za-z0-9#])' || replace(value, '#', '[#]') || '($|[^A-Za-z0-9#])'))
    SELECT kind, min(value) AS value FROM hit GROUP BY kind HAVING count(*) = 1""")
def f11(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    question = p.agg(F.concat(F.lit("show "), F.min("p_brand"), F.lit(" repairs")).alias("q"))
    named = p.select(F.col("p_brand").alias("value"), F.lit("class").alias("kind")).unionByName(p.select(F.col("p_type").alias("value"), F.lit("type").alias("kind"))).distinct()
    escaped = F.replace("value", F.lit("#"), F.lit("[#]"))
    whole = F.concat(F.lit("(^|[^A-Za-z0-9#])"), escaped, F.lit("($|[^A-Za-z0-9#])"))
    hit = named.filter(F.length("value") >= 3).join(question, F.lit(True)).filter(F.regexp_like("q", whole))
    return hit.groupBy("kind").agg(F.count("*").alias("n"), F.min("value").alias("value")).filter("n = 1").select("kind", "value")


@query("f12_resolve_filter", """SELECT n.n_nationkey, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey
    WHERE lower(trim(n.n_name)) IN (SELECT lower(trim(n_name)) FROM nation WHERE n_nationkey % 3 = 0)""")
def f12(spark: SparkSession, sf: str) -> DataFrame:
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    asked = n.filter("n_nationkey % 3 = 0").select(F.lower(F.trim("n_name")).alias("key")).distinct()
    return n.withColumn("key", F.lower(F.trim("n_name"))).join(asked, "key", "left_semi").join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")


@query("f13_filter_precedence", """SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'id' WHEN p_partkey % 4 = 1 THEN 'type' WHEN p_partkey % 4 = 2 THEN 'class' END AS used FROM part""")
def f13(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("p_partkey") % 4
    return table(spark, sf, "part").select("p_partkey", F.coalesce(F.when(kind == 0, "id"), F.when(kind == 1, "type"), F.when(kind == 2, "class")).alias("used"))


@query("f22_wave", """SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 20) ORDER BY o_orderkey LIMIT 25""")
def f22(spark: SparkSession, sf: str) -> DataFrame:
    known = table(spark, sf, "lineitem").filter("l_quantity > 20").select(F.col("l_orderkey").alias("o_orderkey"))
    return wave(table(spark, sf, "orders").select("o_orderkey"), known, 25, "o_orderkey")


@query("f23_owner_rows", "SELECT event_id, event_type FROM events WHERE user_id = 7")
def f23(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").filter("user_id = 7").select("event_id", "event_type")


@query("f24_message_history", "SELECT conv_id, turn, role, text FROM conversations WHERE role IN ('user', 'assistant') AND trim(coalesce(text, '')) <> ''")
def f24(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").filter(F.col("role").isin("user", "assistant") & (F.trim(F.coalesce("text", F.lit(""))) != "")).select("conv_id", "turn", "role", "text")


@query("f25_documents_without_chunks", "SELECT c_custkey FROM customer c WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')")
def f25(spark: SparkSession, sf: str) -> DataFrame:
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders").filter("o_orderstatus = 'P'")
    return c.filter(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey")


@query("j01_inner_join", "SELECT l_orderkey, l_linenumber, o_orderdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity > 45")
def j01(spark: SparkSession, sf: str) -> DataFrame:
    li, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    return li.filter("l_quantity > 45").join(o, li.l_orderkey == o.o_orderkey).select("l_orderkey", "l_linenumber", "o_orderdate")


@query("j02_root_join", """SELECT l.l_orderkey, l.l_linenumber, o.o_custkey AS parent, c.c_custkey AS root FROM lineitem l
    JOIN orders o ON l.l_orderkey = o.o_orderkey LEFT JOIN customer c ON o.o_custkey = c.c_custkey""")
def j02(spark: SparkSession, sf: str) -> DataFrame:
    li, o, c = (table(spark, sf, t) for t in ("lineitem", "orders", "customer"))
    joined = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey, "left")
    return joined.select("l_orderkey", "l_linenumber", F.col("o_custkey").alias("parent"), F.col("c_custkey").alias("root"))


@query("j03_ancestry", """WITH RECURSIVE node AS (SELECT 'r' || r_regionkey AS id, NULL AS parent_id FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation
    UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier), t(id, root_id, depth, path) AS (SELECT id, id, 0, id FROM node WHERE parent_id IS NULL
    UNION ALL SELECT d.id, t.root_id, t.depth + 1, t.path || '/' || t.id FROM node d JOIN t ON d.parent_id = t.id) SELECT id, root_id, depth, path FROM t""")
def j03(spark: SparkSession, sf: str) -> DataFrame:
    r, n, s = (table(spark, sf, t) for t in ("region", "nation", "supplier"))
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    nodes = r.select(name("r", "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent_id")).unionByName(n.select(name("n", "n_nationkey").alias("id"), name("r", "n_regionkey").alias("parent_id")))
    nodes = nodes.unionByName(s.select(name("s", "s_suppkey").alias("id"), name("n", "s_nationkey").alias("parent_id")))
    return with_hierarchy(nodes).select("id", "root_id", "depth", F.array_join("path", "/").alias("path"))


@query("j04_unnest_any", "SELECT count(DISTINCT l_orderkey) AS n FROM lineitem, unnest([3, 5, 8]) AS t(tid) WHERE l_partkey = tid")
def j04(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").filter(F.col("l_partkey").isin(3, 5, 8)).agg(F.count_distinct("l_orderkey").alias("n"))


@query("j05_explode_group", "SELECT topic, count(*) AS n FROM (SELECT unnest([l_partkey, l_suppkey]) AS topic FROM lineitem) GROUP BY topic")
def j05(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(F.explode(F.array("l_partkey", "l_suppkey")).alias("topic")).groupBy("topic").agg(F.count("*").alias("n"))


@query("j06_semi_join", "SELECT o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R')")
def j06(spark: SparkSession, sf: str) -> DataFrame:
    o, li = table(spark, sf, "orders"), table(spark, sf, "lineitem").filter("l_returnflag = 'R'")
    return o.join(li, o.o_orderkey == li.l_orderkey, "left_semi").select("o_orderkey")


@query("j07_broken_parents", "SELECT count(*) AS broken FROM orders o WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND c.c_acctbal > 0)")
def j07(spark: SparkSession, sf: str) -> DataFrame:
    parents = table(spark, sf, "customer").filter("c_acctbal > 0")
    return diff.orphans(table(spark, sf, "orders"), parents, "o_custkey", "c_custkey").agg(F.count("*").alias("broken"))


@query("j08_orphan_rows", "SELECT p_partkey FROM part LEFT JOIN (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity = 50) ON l_partkey = p_partkey WHERE l_partkey IS NULL")
def j08(spark: SparkSession, sf: str) -> DataFrame:
    used = table(spark, sf, "lineitem").filter("l_quantity = 50")
    return diff.orphans(table(spark, sf, "part"), used, "p_partkey", "l_partkey").select("p_partkey")


@query("j10_remote_extras", "SELECT s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_suppkey IS NOT NULL AND l_shipdate < TIMESTAMP '1994-01-01')")
def j10(spark: SparkSession, sf: str) -> DataFrame:
    known = table(spark, sf, "lineitem").filter((F.col("l_shipdate") < "1994-01-01") & F.col("l_suppkey").isNotNull())
    return table(spark, sf, "supplier").join(known, F.col("s_suppkey") == F.col("l_suppkey"), "left_anti").select("s_suppkey")


@query("j11_lookup_join", "SELECT s_suppkey, n_name FROM supplier JOIN nation ON lower(trim(n_name)) = lower(n_name) AND s_nationkey = n_nationkey")
def j11(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").join(table(spark, sf, "nation").filter(F.lower(F.trim("n_name")) == F.lower("n_name")), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")


@query("j15_snapshot_diff", """WITH a AS (SELECT p_partkey, p_size FROM part WHERE p_partkey % 10 <> 0), b AS (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN p_size + 1 ELSE p_size END AS p_size FROM part WHERE p_partkey % 9 <> 0)
    SELECT coalesce(a.p_partkey, b.p_partkey) AS p_partkey, CASE WHEN b.p_partkey IS NULL THEN 'new' WHEN a.p_partkey IS NULL THEN 'stale' WHEN a.p_size IS NOT DISTINCT FROM b.p_size THEN 'unchanged' ELSE 'changed' END AS status
    FROM a FULL JOIN b ON a.p_partkey = b.p_partkey""")
def j15(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select("p_partkey", "p_size")
    remote = p.filter("p_partkey % 9 <> 0").withColumn("p_size", F.when(F.col("p_partkey") % 7 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")))
    return diff.status(p.filter("p_partkey % 10 <> 0"), remote, ["p_partkey"], ["p_size"])


@query("j16_grouped_children", "SELECT o_custkey, count(*) AS orders, min(o_orderkey) AS first_order FROM orders GROUP BY o_custkey")
def j16(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("orders"), F.min("o_orderkey").alias("first_order"))


@query("j17_path_join", """SELECT DISTINCT c.c_custkey, l.l_partkey FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey JOIN lineitem l ON o.o_orderkey = l.l_orderkey JOIN part p ON p.p_partkey = l.l_partkey WHERE p.p_size > 40""")
def j17(spark: SparkSession, sf: str) -> DataFrame:
    c, o, li, p = (table(spark, sf, t) for t in ("customer", "orders", "lineitem", "part"))
    path = li.join(p.filter("p_size > 40"), li.l_partkey == p.p_partkey).join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey)
    return path.select("c_custkey", "l_partkey").distinct()


@query("j19_unexplained", """SELECT event_id FROM events e WHERE event_type = 'error' AND NOT EXISTS (SELECT 1 FROM events x WHERE x.user_id = e.user_id AND x.event_type = 'signup' AND x.value > 100)""")
def j19(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.filter("event_type = 'error'").join(e.filter("event_type = 'signup' and value > 100").select("user_id"), "user_id", "left_anti").select("event_id")


@query("j20_origin_chunk", """WITH f AS (SELECT l_orderkey, min_by(l_partkey, l_linenumber * 10000000 + l_partkey) AS first_part FROM lineitem GROUP BY l_orderkey)
    SELECT o.o_orderkey, c.c_name, f.first_part FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey LEFT JOIN f ON f.l_orderkey = o.o_orderkey""")
def j20(spark: SparkSession, sf: str) -> DataFrame:
    first = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.min_by("l_partkey", F.struct("l_linenumber", "l_partkey")).alias("first_part"))
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).join(first, o.o_orderkey == first.l_orderkey, "left").select("o_orderkey", "c_name", "first_part")


@query("j22_first_context", """SELECT c.c_custkey, (SELECT o.o_orderpriority FROM orders o WHERE o.o_custkey = c.c_custkey ORDER BY o.o_orderkey LIMIT 1) AS context FROM customer c""")
def j22(spark: SparkSession, sf: str) -> DataFrame:
    first = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min_by("o_orderpriority", "o_orderkey").alias("context"))
    return table(spark, sf, "customer").select("c_custkey").join(first, "c_custkey", "left")


@query("a01_filtered_count", "SELECT count(*) AS n FROM lineitem WHERE l_partkey = 5 AND l_returnflag = 'N'")
def a01(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").filter("l_partkey = 5 AND l_returnflag = 'N'").agg(F.count("*").alias("n"))


@query("a03_corpus_stats", """SELECT count(*) AS documents, count(*) FILTER (WHERE lang = 'en') AS english, count(*) FILTER (WHERE n_chars > 5000) AS long, (SELECT count(*) FROM labels) AS labels, (SELECT count(*) FROM pages) AS pages FROM documents""")
def a03(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").agg(F.count("*").alias("documents"), F.count_if(F.col("lang") == "en").alias("english"), F.count_if(F.col("n_chars") > 5000).alias("long"))
    for name in ("labels", "pages"):
        d = d.join(table(spark, sf, name).agg(F.count("*").alias(name)), F.lit(True))
    return d


@query("a04_fingerprint", "SELECT count(*) AS n, max(ts) AS changed FROM events")
def a04(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").agg(F.count("*").alias("n"), F.max("ts").alias("changed"))


@query("a05_group_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def a05(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"))


@query("a05_pivot", """SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'error') AS error, count(*) FILTER (WHERE event_type = 'purchase') AS purchase FROM events GROUP BY user_id""")
def a05p(spark: SparkSession, sf: str) -> DataFrame:
    pivoted = table(spark, sf, "events").groupBy("user_id").pivot("event_type", ["click", "error", "purchase"]).agg(F.count(F.lit(1)))
    return pivoted.fillna(0)


@query("a06_per_document", "SELECT CAST(min(n) AS BIGINT) AS least, CAST(max(n) AS BIGINT) AS most, CAST(sum(n) // count(*) AS BIGINT) AS average FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey)")
def a06(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return n.agg(F.min("n").alias("least"), F.max("n").alias("most"), F.floor(F.sum("n") / F.count("*")).alias("average"))


@query("a07_recount", """SELECT p.p_partkey AS id, count(DISTINCT l.l_orderkey || ':' || l.l_linenumber) AS chunk_count, count(DISTINCT l.l_orderkey) AS document_count FROM part p JOIN lineitem l ON l.l_partkey = p.p_partkey GROUP BY p.p_partkey""")
def a07(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select(F.concat_ws(":", "l_orderkey", "l_linenumber").alias("chunk_id"), F.col("l_orderkey").alias("document_id"), F.col("l_partkey").alias("topic_id"))
    return recount(table(spark, sf, "part").select(F.col("p_partkey").alias("id")), li.select("chunk_id", "topic_id"), li.select("chunk_id", "document_id"))


@query("a08_duplicates", "SELECT sha256(text) AS file_hash, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def a08(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").filter("text is not null")
    return d.groupBy(F.sha2("text", 256).alias("file_hash")).agg(F.count("*").alias("n")).filter("n > 1")


@query("a09_distinct_array", "SELECT l_orderkey, array_to_string(list_sort(list_distinct(list(l_partkey % 50))), ',') AS topics FROM lineitem GROUP BY l_orderkey")
def a09(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set(F.col("l_partkey") % 50)).cast("array<string>"), ",").alias("topics"))


@query("a10_sorted_attributes", "SELECT p_brand, string_agg(DISTINCT p_type, '|' ORDER BY p_type) AS types FROM part GROUP BY p_brand")
def a10(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_set("p_type")), "|").alias("types"))


@query("a15_set_changes", """WITH a AS (SELECT DISTINCT l_orderkey AS k, l_partkey % 20 AS v FROM lineitem WHERE l_linenumber <= 2), b AS (SELECT DISTINCT l_orderkey AS k, l_partkey % 20 AS v FROM lineitem WHERE l_linenumber >= 2)
    SELECT v AS value, CAST(sum(CASE WHEN s = 1 THEN 1 ELSE 0 END) AS BIGINT) AS added, CAST(sum(CASE WHEN s = -1 THEN 1 ELSE 0 END) AS BIGINT) AS removed
    FROM ((SELECT *, 1 AS s FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) UNION ALL (SELECT *, -1 AS s FROM (SELECT * FROM a EXCEPT SELECT * FROM b))) GROUP BY v""")
def a15(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").withColumn("v", F.col("l_partkey") % 20)
    sets = li.groupBy("l_orderkey").agg(F.collect_set(F.when(F.col("l_linenumber") <= 2, F.col("v"))).alias("before"), F.collect_set(F.when(F.col("l_linenumber") >= 2, F.col("v"))).alias("after"))
    changes = diff.set_changes(sets, "l_orderkey", F.col("before"), F.col("after"))
    return changes.groupBy("value").agg(F.count_if(F.col("change") == 1).alias("added"), F.count_if(F.col("change") == -1).alias("removed"))


@query("a16_integrity_histogram", """WITH r AS (SELECT l_partkey AS id FROM lineitem), k AS (SELECT p_partkey AS id FROM part WHERE p_size > 5)
    SELECT r.id, count(*) AS refs FROM r LEFT JOIN k ON r.id = k.id WHERE k.id IS NULL GROUP BY r.id ORDER BY refs DESC, r.id LIMIT 10""")
def a16(spark: SparkSession, sf: str) -> DataFrame:
    refs = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("id")).join(table(spark, sf, "part").filter("p_size > 5").select(F.col("p_partkey").alias("id")), "id", "left_anti")
    return refs.groupBy("id").agg(F.count("*").alias("refs")).orderBy(F.desc("refs"), "id").limit(10)


@query("a17_cost_scan", "SELECT p_type AS category, count(*) AS files, CAST(sum(p_size) AS BIGINT) AS pages, round(sum(p_retailprice), 2) AS cost FROM part GROUP BY p_type")
def a17(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").groupBy(F.col("p_type").alias("category")).agg(F.count("*").alias("files"), F.sum("p_size").alias("pages"), F.round(F.sum("p_retailprice"), 2).alias("cost"))


@query("a18_events_by_reason", """WITH c AS (SELECT max(ts) - INTERVAL 1 DAY AS cut FROM events) SELECT event_type AS reason, count(*) AS total, count(*) FILTER (WHERE ts >= cut) AS last_run FROM events, c GROUP BY event_type""")
def a18(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    cut = e.agg((F.max("ts") - F.expr("INTERVAL 1 DAY")).alias("cut"))
    return e.join(cut, F.lit(True)).groupBy(F.col("event_type").alias("reason")).agg(F.count("*").alias("total"), F.count_if(F.col("ts") >= F.col("cut")).alias("last_run"))


@query("a19_rollup_to_root", "SELECT o_custkey AS root_id, count(*) AS incomplete FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_tax = 0 GROUP BY o_custkey")
def a19(spark: SparkSession, sf: str) -> DataFrame:
    li, o = table(spark, sf, "lineitem").filter("l_tax = 0"), table(spark, sf, "orders")
    return li.join(o, li.l_orderkey == o.o_orderkey).groupBy(F.col("o_custkey").alias("root_id")).agg(F.count("*").alias("incomplete"))


@query("a20_parser_attribution", """SELECT CASE WHEN l_shipdate < TIMESTAMP '1994-01-01' THEN 'local' WHEN l_returnflag = 'R' THEN 'cloud' ELSE 'legacy' END AS parser, count(*) AS n FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1""")
def a20(spark: SparkSession, sf: str) -> DataFrame:
    parser = F.when(F.col("l_shipdate") < "1994-01-01", "local").when(F.col("l_returnflag") == "R", "cloud").otherwise("legacy")
    return table(spark, sf, "lineitem").filter("l_linestatus = 'F'").groupBy(parser.alias("parser")).agg(F.count("*").alias("n"))


@query("a22_model_latency", """SELECT event_type AS model, count(*) AS runs, round(quantile_cont(value, 0.5), 6) AS p50, max(CASE WHEN n = least(CAST(floor(c * 0.95) AS BIGINT), c - 1) THEN round(value, 6) END) AS p95
    FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS n, count(*) OVER (PARTITION BY event_type) AS c FROM events WHERE value IS NOT NULL) GROUP BY event_type""")
def a22(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").filter("value is not null")
    at = evals.values_at(e, "value", ["event_type"], evals.MEDIAN | {"p95": lambda n: F.least(F.floor(n * 0.95), n - 1)})
    runs = e.groupBy("event_type").agg(F.count("*").alias("runs")).withColumn("_key", F.struct(F.lit(0), "event_type")).join(at, "_key")
    return runs.select(F.col("event_type").alias("model"), "runs", F.round((F.col("lower") + F.col("upper")) / 2, 6).alias("p50"), F.round("p95", 6).alias("p95"))


@query("a24_version_histogram", "SELECT p_size % 5 AS ingest_version, count(*) AS n FROM part WHERE p_size % 5 < 4 GROUP BY 1")
def a24(spark: SparkSession, sf: str) -> DataFrame:
    return outdated(table(spark, sf, "part").withColumn("ingest_version", F.col("p_size") % 5), 4)


@query("a25_thread_summary", """SELECT conv_id, string_agg(DISTINCT role, ',' ORDER BY role) AS participants, min(turn) AS first_turn, max(turn) AS last_turn, min_by(role, turn) AS initiator, count(*) AS messages FROM conversations GROUP BY conv_id""")
def a25(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").groupBy("conv_id").agg(
        F.array_join(F.array_sort(F.collect_set("role")), ",").alias("participants"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.min_by("role", "turn").alias("initiator"), F.count("*").alias("messages")
    )


@query("w01_latest_per_key", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def w01(spark: SparkSession, sf: str) -> DataFrame:
    newest = table(spark, sf, "events").groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type"), F.struct("ts", "event_id")).alias("e"))
    return newest.select("user_id", "e.event_id", "e.event_type")


@query("w02_gap_sessions", """WITH g AS (SELECT user_id, ts, event_id, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w > 3600 * 1000000::BIGINT OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM g) SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n FROM s GROUP BY 1, 2""")
def w02(spark: SparkSession, sf: str) -> DataFrame:
    return windows.sessions(table(spark, sf, "events"), ["user_id"], "ts", 60).groupBy("user_id", "session").agg(F.count("*").alias("n"))


@query("w04_first_seen_index", """SELECT l_orderkey, l_linenumber, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY f) AS "index" FROM (SELECT *, min(l_linenumber) OVER (PARTITION BY l_orderkey, l_returnflag) AS f FROM lineitem)""")
def w04(spark: SparkSession, sf: str) -> DataFrame:
    out = windows.first_seen_index(table(spark, sf, "lineitem"), ["l_orderkey"], "l_returnflag", "l_linenumber")
    return out.select("l_orderkey", "l_linenumber", F.col("index").cast("bigint").alias("index"))


@query("w05_first_chunk", "SELECT l_orderkey, min_by(l_partkey, l_linenumber * 10000000 + l_partkey) AS chunk FROM lineitem WHERE l_linenumber >= 0 GROUP BY l_orderkey")
def w05(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").filter("l_linenumber >= 0").groupBy("l_orderkey").agg(F.min_by("l_partkey", F.struct("l_linenumber", "l_partkey")).alias("chunk"))


@query("w08_keeper", "SELECT p_brand, p_partkey AS keeper FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS n FROM part) WHERE n = 1")
def w08(spark: SparkSession, sf: str) -> DataFrame:
    return dml.latest(table(spark, sf, "part"), ["p_brand"], [F.desc("p_size"), F.col("p_partkey")]).select("p_brand", F.col("p_partkey").alias("keeper"))


@query("w09_rank_cutoffs", """SELECT o_custkey, count(*) FILTER (WHERE n <= 5) AS at_5, count(*) FILTER (WHERE n <= 10) AS at_10, count(*) FILTER (WHERE n <= 20) AS at_20 FROM (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) GROUP BY o_custkey""")
def w09(spark: SparkSession, sf: str) -> DataFrame:
    ranked = table(spark, sf, "orders").withColumn("n", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")))
    return ranked.groupBy("o_custkey").agg(*[F.count_if(F.col("n") <= k).alias(f"at_{k}") for k in (5, 10, 20)])


@query("w10_retention", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS n FROM events) WHERE n <= 3")
def w10(spark: SparkSession, sf: str) -> DataFrame:
    return windows.newest(table(spark, sf, "events"), ["user_id"], [F.desc("ts"), F.col("event_id")], 3).select("user_id", "event_id")


@query("w11_surplus_stubs", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC) AS n FROM orders) WHERE n > 1")
def w11(spark: SparkSession, sf: str) -> DataFrame:
    return windows.surplus(table(spark, sf, "orders"), ["o_custkey"], [F.desc_nulls_last("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("k06_topic_order", "SELECT p_partkey, p_name, p_size FROM part ORDER BY p_size DESC, p_name, p_partkey LIMIT 100")
def k06(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").orderBy(F.desc("p_size"), "p_name", "p_partkey").limit(100).select("p_partkey", "p_name", "p_size")


@query("k07_paged_listing", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_custkey = 1 OR o_custkey = 4 ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC LIMIT 10 OFFSET 5")
def k07(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").filter("o_custkey IN (1, 4)").orderBy(F.desc_nulls_last("o_orderdate"), F.desc("o_orderkey")).offset(5).limit(10).select("o_orderkey", "o_orderdate")


@query("k09_top_by_size", "SELECT doc_id, n_chars FROM documents WHERE lang = 'de' ORDER BY n_chars DESC, doc_id LIMIT 10")
def k09(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").filter("lang = 'de'").orderBy(F.desc("n_chars"), "doc_id").limit(10).select("doc_id", "n_chars")


@query("k11_most_common", "SELECT p_type, count(*) AS n FROM part GROUP BY p_type ORDER BY n DESC, p_type LIMIT 10")
def k11(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").groupBy("p_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p_type").limit(10)


@query("k12_newest_first", "SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def k12(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(50).select("o_orderkey")


@query("d02_union_of_sources", """SELECT 'order' AS source, o_orderkey AS id, NULL AS reason FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'event', event_id, event_type FROM events WHERE event_type = 'error' UNION ALL SELECT 'part', p_partkey, p_type FROM part WHERE p_size = 1""")
def d02(spark: SparkSession, sf: str) -> DataFrame:
    rows = lambda name, t, key, where, *more: table(spark, sf, t).filter(where).select(F.lit(name).alias("source"), F.col(key).alias("id"), *more)
    out = rows("event", "events", "event_id", "event_type = 'error'", F.col("event_type").alias("reason")).unionByName(rows("part", "part", "p_partkey", "p_size = 1", F.col("p_type").alias("reason")))
    return out.unionByName(rows("order", "orders", "o_orderkey", "o_orderstatus = 'F'"), allowMissingColumns=True)


@query("d04_intersection", "SELECT l_partkey AS id FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT p_partkey FROM part WHERE p_size < 25")
def d04(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("id")).intersect(table(spark, sf, "part").filter("p_size < 25").select(F.col("p_partkey").alias("id")))


@query("d06_upsert", """SELECT p_partkey, p_size FROM part WHERE p_partkey % 5 <> 0 UNION ALL SELECT p_partkey, p_size + 100 FROM part WHERE p_partkey % 5 = 0 UNION ALL SELECT p_partkey + 1000000, p_size + 100 FROM part WHERE p_partkey % 50 = 0""")
def d06(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select("p_partkey", "p_size")
    changed = p.filter("p_partkey % 5 = 0").withColumn("p_size", F.col("p_size") + 100)
    added = p.filter("p_partkey % 50 = 0").select((F.col("p_partkey") + 1000000).alias("p_partkey"), (F.col("p_size") + 100).alias("p_size"))
    return dml.upsert(p, changed.unionByName(added), ["p_partkey"])


@query("d08_insert_ignore", "SELECT DISTINCT l_orderkey, l_partkey % 100 AS topic FROM lineitem")
def d08(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select("l_linenumber", "l_orderkey", (F.col("l_partkey") % 100).alias("topic"))
    first, more = (rows.filter(c).drop("l_linenumber") for c in ("l_linenumber = 1", "l_linenumber > 1"))
    return dml.insert_ignore(first.distinct(), more, ["l_orderkey", "topic"])


@query("d09_cascade_delete", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def d09(spark: SparkSession, sf: str) -> DataFrame:
    gone = table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select("c_custkey")
    return dml.cascade_delete({"orders": (table(spark, sf, "orders"), "o_custkey")}, gone, "c_custkey")["orders"].select("o_orderkey")


@query("d10_replace_groups", """SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey % 4 <> 0 UNION ALL SELECT l_orderkey, 1, max(l_partkey) FROM lineitem WHERE l_orderkey % 4 = 0 GROUP BY l_orderkey""")
def d10(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    new = li.filter("l_orderkey % 4 = 0").groupBy("l_orderkey").agg(F.max("l_partkey").alias("l_partkey")).withColumn("l_linenumber", F.lit(1))
    return dml.replace_groups(li, new.select(*li.columns), "l_orderkey")


@query("d11_rewrite_ids", """WITH c AS (SELECT l_orderkey, list_sort(list_distinct(list(l_partkey % 30))) AS before, list_sort(list_distinct(list(CASE WHEN l_partkey % 30 < 10 THEN 10 ELSE l_partkey % 30 END))) AS after FROM lineitem GROUP BY 1) SELECT l_orderkey, array_to_string(after, ',') AS topics FROM c""")
def d11(spark: SparkSession, sf: str) -> DataFrame:
    chunks = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.col("l_partkey") % 30)).alias("topic_ids"))
    mapping = spark.range(10).select(F.col("id").alias("old"), F.lit(10).cast("bigint").alias("new"))
    out, _ = dml.rewrite_ids(chunks, mapping, "topic_ids", "l_orderkey")
    return out.select("l_orderkey", F.array_join(F.col("topic_ids").cast("array<string>"), ",").alias("topics"))


@query("d13_counters", "SELECT p_partkey, p_size + (SELECT count(*) FROM lineitem WHERE l_partkey = p_partkey) AS n FROM part")
def d13(spark: SparkSession, sf: str) -> DataFrame:
    deltas = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.lit(1).alias("delta"))
    return dml.apply_counters(table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("bigint").alias("n")), deltas, "p_partkey", "n", "delta")


@query("d14_apply_merges", "SELECT DISTINCT l_orderkey AS chunk_id, l_partkey - l_partkey % 3 AS topic_id FROM lineitem")
def d14(spark: SparkSession, sf: str) -> DataFrame:
    bridge = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("chunk_id"), F.col("l_partkey").alias("topic_id"))
    merges = table(spark, sf, "part").filter("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("absorbed"), (F.col("p_partkey") - F.col("p_partkey") % 3).alias("keeper"))
    return dml.apply_merges(bridge, merges)


@query("d16_reset_stale", """SELECT event_id, CASE WHEN event_type = 'click' AND ts < TIMESTAMP '2024-01-15' THEN 'FAILED' WHEN event_type = 'click' THEN 'PROCESSING' ELSE 'COMPLETED' END AS status FROM events""")
def d16(spark: SparkSession, sf: str) -> DataFrame:
    log = table(spark, sf, "events").select("event_id", F.when(F.col("event_type") == "click", "PROCESSING").otherwise("COMPLETED").alias("status"), F.col("ts").cast("timestamp").alias("started_at"), F.lit(None).cast("string").alias("error"))
    return dml.reset_stale(log, F.lit("2024-01-15 00:30:00").cast("timestamp"), 30).select("event_id", "status")


@query("d18_coalesce_update", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 AND c_acctbal > 0 THEN 'new' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def d18(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    changes = c.filter("c_custkey % 3 = 0").select("c_custkey", F.when(F.col("c_acctbal") > 0, "new").alias("c_mktsegment"))
    return dml.coalesce_update(c.drop("c_acctbal"), changes, ["c_custkey"], ["c_mktsegment"])


@query("d21_prune", "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity < 10)")
def d21(spark: SparkSession, sf: str) -> DataFrame:
    keep = table(spark, sf, "lineitem").filter("l_quantity < 10").select(F.col("l_partkey").alias("p_partkey"))
    return dml.prune(table(spark, sf, "part"), keep, ["p_partkey"]).select("p_partkey")


@query("d22_backfill", """WITH b AS (SELECT DISTINCT o_custkey AS root, l_partkey % 10 AS topic FROM lineitem JOIN orders ON l_orderkey = o_orderkey), c AS (SELECT DISTINCT o_orderkey AS chunk_id, o_custkey AS root FROM orders),
    have AS (SELECT DISTINCT l_orderkey AS chunk_id, l_partkey % 10 AS topic FROM lineitem) SELECT c.chunk_id, b.topic AS topic_id FROM c JOIN b ON c.root = b.root EXCEPT SELECT chunk_id, topic FROM have""")
def d22(spark: SparkSession, sf: str) -> DataFrame:
    o, li = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    own = li.select(F.col("l_orderkey").alias("chunk_id"), (F.col("l_partkey") % 10).alias("topic_id")).distinct()
    root = F.concat(F.lit("c"), F.col("o_custkey").cast("string"))
    of_root = li.join(o, li.l_orderkey == o.o_orderkey).select((-F.col("l_orderkey") - 1).alias("chunk_id"), root.alias("document_id"), (F.col("l_partkey") % 10).alias("topic_id"))
    order = F.concat(F.lit("o"), F.col("o_orderkey").cast("string"))
    chunks = o.select(F.col("o_orderkey").alias("chunk_id"), order.alias("document_id")).unionByName(of_root.select("chunk_id", "document_id").distinct())
    return dml.backfill(own.unionByName(of_root.select("chunk_id", "topic_id").distinct()), o.select(order.alias("document_id"), root.alias("root_id")), chunks)


@query("d23_repoint_suffix", "SELECT page_id, CASE WHEN right(url, 5) = '.html' THEN left(url, length(url) - 5) || '.md' ELSE url END AS url FROM pages")
def d23(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", dml.repoint_suffix(F.col("url"), F.lit(".html"), F.lit(".md")).alias("url"))


@query("d24_partial_update", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer")
def d24(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    changes = c.select("c_custkey", F.struct((F.col("c_custkey") % 2 == 0).alias("provided"), F.lit(None).cast("string").alias("value")).alias("c_mktsegment"))
    return dml.partial_update(c, changes, ["c_custkey"], ["c_mktsegment"])


@query("q05_vector_dimensions", "SELECT count(*) FILTER (WHERE embedding IS NULL) AS missing, array_to_string(list_sort(list(DISTINCT len(embedding))), ',') AS dimensions FROM embeddings")
def q05(spark: SparkSession, sf: str) -> DataFrame:
    return embedding_dimensions(table(spark, sf, "embeddings")).select("missing", F.array_join(F.col("dimensions").cast("array<string>"), ",").alias("dimensions"))


@query("s19_folder_listing", "SELECT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS folder, count(*) AS files, CAST(sum(length(html)) AS BIGINT) AS size FROM pages GROUP BY 1")
def s19(spark: SparkSession, sf: str) -> DataFrame:
    host = F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1)
    return table(spark, sf, "pages").groupBy(host.alias("folder")).agg(F.count("*").alias("files"), F.sum(F.length("html").cast("bigint")).alias("size"))


@query("s18_json_properties", "SELECT event_id, CASE WHEN json_valid(props) THEN json_type(props) END AS kind FROM events WHERE props IS NOT NULL")
def s18(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.try_parse_json("props").isNotNull(), F.upper(F.regexp_extract(F.schema_of_variant(F.try_parse_json("props")), "^([A-Z]+)", 1)))
    return table(spark, sf, "events").filter("props is not null").select("event_id", kind.alias("kind"))


@query("t04_safe_names", r"""SELECT page_id, regexp_replace(url, '[/\\<>:"|?*]', '_', 'g') AS name FROM pages WHERE length(url) <= 255""")
def t04(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").filter(F.length("url") <= 255).select("page_id", txt.safe_file_name(F.col("url")).alias("name"))
