"""The queries of the numbered operators: each applies one operator, with its production parameters, to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm import ann, bpe, conversation_repair, html_text, language_id, merkle, mixing, near_dup, oracles, packing, pii, quality_classifier, quality_rules, toxicity
from dossier.llm.common import cut, fold, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", fold("doc_id", 5) == 0)
    model = toxicity.learn(docs.filter("not held_out"), table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.select("doc_id", "held_out", "text"), model)
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = bpe.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary_path())
    return done.select("doc_id", *bpe.digests(done))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", fold("doc_id", 4) == 2)
    model = language_id.learn(docs.filter("not held_out"))
    return language_id.predict(docs.select("doc_id", "held_out", "text"), model)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", fold("doc_id", 5) == 0)
    model = quality_classifier.learn(docs.filter("not held_out"), table(spark, sf_dir, "labels"))
    scored = quality_classifier.score(docs.select("doc_id", "held_out", "text"), model)
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 50 == 0, k=5)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rules")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind_no"] < len(pii.BASE))
    of = lambda k: F.filter("spans", lambda s: s["kind"] == k)
    n = [F.size(of(k)).cast("bigint").alias(f"n_{k}") for k in pii.BASE]
    return found.select(F.col("row.doc_id").alias("doc_id"), *n, F.sha2(pii.digest(base), 256).alias("base_sha256"), pii.digest(F.col("spans")).alias("spans"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op9_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", near_dup.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return conversation_repair.report(conversations, conversation_repair.damage(conversations))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    leaf, other = (merkle.leaf_digest(*fields, text) for text in (F.col("text"), F.replace("text", F.lit("\n"), F.lit(""))))
    rows = docs.select(merkle.source_key(F.col("source")).alias("source"), F.col("doc_id").alias("id"), leaf.alias("leaf"), F.when(hit, other).otherwise(leaf).alias("read"))
    proven = merkle.manifest(rows).withColumn("folded_root", merkle.folded(F.col("read"), F.col("steps")))
    proof = F.sha2(merkle.proof(F.col("steps")), 256).alias("proof_sha256")
    return proven.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", proof, "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def word_vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pieces(table(spark, sf_dir, "documents").select("doc_id", "text"), word_vocabulary_path())
    digests = cut(packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens"), "pieces")
    done = packing.numbered(digests, ["doc_id", "start", "ids_crc32"])
    return done.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"op11_conversation_repair": oracles.conversation_repair_sql(), "op12_merkle": oracles.merkle_sql()}
