"""From raw documents to token ids: five operators in order, each over all that the one before it kept.

STAGES lists (name, function); every function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return
the columns of documents. Its result has no SQL form (a trained model, sketches of sources, BPE), so ORACLE_SQL is None
and tests hold each stage against brute force.

Cases of documents: a null text, or one without letters, is of no told language and goes in the first stage, so no later stage meets
one; later stages alone keep it, as an empty text. Very long texts pass every stage whole. Repeated rows are one document of their group
in near-dedup, the one of the smallest id, of equal ids the least row; in the other stages they are rows of their own. An empty table gives
an empty result of the same columns. Extra columns are carried to the stage before the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm import bpe, language_id, mixing, near_dup, pii
from dossier.llm.common import cut, fold, table
from dossier.llm.queries import vocabulary_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; those without letters or with too even scores go."""
    model = language_id.learn(docs.filter(fold("doc_id", 4) != 2))
    return language_id.identified(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the smallest id."""
    return near_dup.one_of_each(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with personal data replaced by its kind; n_chars follows the text."""
    clean = pii.redacted(docs)
    return clean.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns) if "n_chars" in docs.columns else clean


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents 0, 1 or 2 times each, so that the sources' words meet their targets."""
    return mixing.apply_mix(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the text decoded from them."""
    done = bpe.round_trip(docs.select("doc_id", "lang", "source", "text"), vocabulary_path())
    return done.select("doc_id", "lang", "source", "ids", *bpe.digests(done))


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("pii", redact_personal_data),
    ("mixing", mix_sources),
    ("bpe", tokenize),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
