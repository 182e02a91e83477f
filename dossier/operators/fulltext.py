"""A stored full-text index: lexemes with their positions, kept by bucket of the lexeme, and ranked matches of queries.

A text's words are runs of letters and digits, in lower case, numbered from 1. English lexemes are stems of words that are no
stop words (these keep their numbers); plain ones are the words themselves. Postings lie in folders by a hash of the lexeme and are sorted
within them, so a query reads the folders of its lexemes and, in those, the row groups that hold them. Matches hold all lexemes of
a query and are ranked by how near these stand to each other.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from dossier.cuts import cut
from dossier.functions.stemming import STOP_WORDS, stem

WORDS = r"[\p{L}\p{N}]+"
BUCKETS = 32
#: Fixed values of the rank: the weight of a word, and how weights of two words fall with their distance.
WEIGHT, NEAR, FALL, SPREAD, SHIFT = 0.1, 1.005, 0.05, 1.5, 2.0
SQUARES = 1.64493406685  # the sum of 1 / n ** 2


def lexeme(word: str, english: bool = True) -> str | None:
    """What a lowercase word is found by; None for a stop word."""
    return word if not english else None if word in STOP_WORDS else stem(word)


def query_lexemes(query: str, english: bool = True) -> list[str]:
    """A query's different lexemes, all of which a match must hold."""
    found = (lexeme(w, english) for w in re.findall(r"[^\W_]+", query.lower()))
    return sorted({x for x in found if x is not None})


def postings(texts: DataFrame, key: str, text: str, english: bool = True) -> DataFrame:
    """key, lexeme, positions of every lexeme of every text. A null text has none."""
    words = texts.select(key, F.array_join(F.regexp_extract_all(F.lower(F.col(text)), F.lit(WORDS), F.lit(0)), " ").alias("_words"))
    schema = T.StructType([texts.schema[key], T.StructField("lexeme", T.StringType()), T.StructField("positions", T.ArrayType(T.IntegerType()))])
    kinds = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 200):
                rows, names, places = [], [], []
                for i, spelled in enumerate(b.column("_words").slice(k, 200).to_pylist()):
                    held: dict[str, list[int]] = {}
                    for at, word in enumerate(spelled.split(" ") if spelled else (), 1):
                        if (x := lexeme(word, english)) is not None:
                            held.setdefault(x, []).append(at)
                    rows.extend([k + i] * len(held))
                    names.extend(held)
                    places.extend(held.values())
                if rows:
                    keys = b.column(key).take(pa.array(rows)).cast(kinds.field(0).type)
                    yield pa.RecordBatch.from_arrays([keys, pa.array(names, pa.string()), pa.array(places, kinds.field(2).type)], schema=kinds)

    return words.mapInArrow(run, schema)


def bucket(name):
    return F.pmod(F.xxhash64(name), F.lit(BUCKETS)).cast("int")


def build(texts: DataFrame, path: str, key: str, text: str, english: bool = True) -> None:
    """Stores the postings of all texts under path. A lexeme of any number of texts spreads over tasks, as ranges of keys."""
    found = cut(postings(texts, key, text, english), "postings").withColumn("bucket", bucket("lexeme"))  # ranges read it twice
    order = ["bucket", "lexeme", key]
    found.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("append").partitionBy("bucket").parquet(path)


def rank(places: list[np.ndarray]) -> float:
    """The rank of a text that holds each lexeme at the given places: of one lexeme the more the higher, of several by all pairs of places."""
    if len(places) == 1:
        return float(WEIGHT * (1.0 / np.arange(1, len(places[0]) + 1) ** 2).sum() / SQUARES)
    apart = 0.0  # the logarithm of the product of what each pair leaves
    for i, x in enumerate(places):
        for y in places[:i]:
            for part in np.array_split(x, len(x) * len(y) // 1_000_000 + 1):
                distance = np.abs(np.subtract.outer(part.astype(np.float64), y.astype(np.float64)))
                near = 1.0 / (NEAR + FALL * np.exp(np.minimum(distance / SPREAD - SHIFT, 80.0)))
                apart += np.log1p(-WEIGHT * np.sqrt(near)).sum()
    return float(-np.expm1(apart))


@F.pandas_udf(T.DoubleType())
def _ranks(held: pd.Series) -> pd.Series:
    return pd.Series([rank([np.asarray(p["positions"]) for p in row]) for row in held], dtype="float64")


def matches(spark: SparkSession, path: str, query: str, key: str, english: bool = True, within: DataFrame | None = None) -> DataFrame:
    """key and rank of the texts that hold all lexemes of the query; none for a query without any. `within` has the keys to look at."""
    wanted = query_lexemes(query, english)
    stored = spark.read.parquet(path)
    if not wanted:
        return stored.select(key, F.lit(0.0).alias("rank")).limit(0)
    # the buckets as literals, so that the scan lists only their folders
    folders = [r[0] for r in spark.createDataFrame([(w,) for w in wanted], "lexeme string").select(bucket("lexeme")).distinct().collect()]
    found = stored.filter(F.col("bucket").isin(folders) & F.col("lexeme").isin(wanted)).select(key, "lexeme", "positions")
    if within is not None:
        found = found.join(within.select(key).distinct(), key, "left_semi")
    whole = found.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("lexeme", "positions"))).alias("held")).filter(F.size("held") == len(wanted))
    return whole.select(key, _ranks("held").alias("rank"))
