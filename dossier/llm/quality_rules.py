"""Quality rules with adaptive thresholds [native].

Each document's rates (characters per word, symbols per word, repeated lines, repeated 5-word windows) are compared with
fences of its own language and source: quartile + WIDTH * spread. The quartiles come from sketches that count values in bins
of a relative width (each bound is GAMMA times the one before): adding up the counts merges them, the bins are few whatever
the number of documents, a quantile is off by (GAMMA - 1) / 2 of its value at most, and neither the order nor the
partitioning of the rows changes a count. Sketches of (language, source) add up to those of the language and of the corpus.
A group's quartiles are drawn towards its language's as if PRIOR documents of it stood beside the group's own, and these
towards the corpus likewise, so small groups have sound fences and no size changes the rule. The fences are then joined to
the documents.

Defined cases: a null text has no words (base_failed); null language or source are groups of their own; a very long text is
counted whole; a rate equal to its fence passes; repeated rows are judged each; columns named like a new one are left out; an
empty table gives an empty result. A group may hold any share of the rows: sketches are built before the shuffle, and the
joined fences are one row per group.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.llm.common import WORD, cut

SYMBOLS = r"[#*$%&|<>]"
SPACE = r"[\x20\x09-\x0D]"
WINDOW = 5
LEAST_WORDS, MOST_REPEATED = 10, 20  # the base rules
GAMMA = 1.01  # of two neighbouring bounds of a sketch's bins
PRIOR = 10.0  # documents of the language beside a group's own
WIDTH = 3.0
#: rate -> (least spread, what a short document may add: divided by the root of its length, "lower" fence too)
FENCES = {"chars_per_word": (1.0, 9.0, True), "symbols_per_word": (0.05, 1.0, False), "dup_line_share": (0.1, 1.0, False), "repeat_share": (0.05, 0.5, False)}


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words for each row.

    Repeated windows: a hash of each 5-word window with its position is sorted inside the row; windows with an equal
    neighbour are those found twice, and the words they cover are counted from the gaps between their positions.
    Only texts with a repeated hash pay for the sort.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(
        F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), text.alias("text")
    )
    word_hashes = F.transform(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w))
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))
    base = base.select(
        "doc_id", "lang", "source",
        (F.length("text") - F.regexp_count("text", F.lit(SPACE))).cast("bigint").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
        word_hashes.alias("words"), lines.alias("lines"),
    )
    at = lambda i, k: F.get(F.col("words"), i + k)
    windows = F.when(
        F.size("words") >= WINDOW,
        F.transform(F.sequence(F.lit(0), F.size("words") - WINDOW), lambda i: F.xxhash64(*[at(i, k) for k in range(WINDOW)])),
    ).otherwise(F.array().cast("array<bigint>"))
    base = base.select(
        "doc_id", "lang", "source", "word_chars", "n_symbols", F.size("words").cast("bigint").alias("n_words"), F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"), windows.alias("windows"),
    )
    placed = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    base = base.withColumn("placed", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), placed)).drop("windows")
    same = lambda x, j: F.coalesce(F.get(F.col("placed"), j)["h"] == x["h"], F.lit(False))
    twice = F.sort_array(F.transform(F.filter("placed", lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"]))
    base = base.withColumn("twice", twice).drop("placed")
    covered = F.aggregate(
        F.zip_with("twice", F.slice("twice", F.lit(2), F.size("twice")), lambda a, b: F.coalesce(F.least(b - a, F.lit(WINDOW)), F.lit(WINDOW))),
        F.lit(0).cast("bigint"), lambda acc, x: acc + x,
    )
    return base.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("bigint")).drop("twice")


def with_rates(counted: DataFrame) -> DataFrame:
    per = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    return counted.withColumns(
        {"chars_per_word": per("word_chars", "n_words"), "symbols_per_word": per("n_symbols", "n_words"), "dup_line_share": per("n_dup_lines", "n_lines"), "repeat_share": per("n_repeat_words", "n_words")}
    )


def sketches(rated: DataFrame, *by: str) -> DataFrame:
    """by, rate, bin, n: how many documents with words have the rate in the bin. Bin null: the rate is 0."""
    rates = F.explode(F.array(*[F.struct(F.lit(c).alias("rate"), F.col(c).alias("value")) for c in FENCES])).alias("r")
    bins = F.when(F.col("r.value") > 0, F.ceil(F.log(F.col("r.value")) / F.lit(math.log(GAMMA)))).cast("int")
    return rated.filter("n_words > 0").select(*by, rates).groupBy(*by, F.col("r.rate").alias("rate"), bins.alias("bin")).agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, *by: str) -> DataFrame:
    return sketch.groupBy(*by, "rate", "bin").agg(F.sum("n").alias("n"))


def quartiles(sketch: DataFrame, *by: str) -> DataFrame:
    """by, rate, n, q1, q3 of each group: the middles of the bins that hold them. A window sees the bins of one group."""
    key = [*by, "rate"]
    total, upto = F.sum("n").over(Window.partitionBy(*key)), F.sum("n").over(Window.partitionBy(*key).orderBy(F.col("bin").asc_nulls_first()))
    value = F.coalesce(F.lit(2.0 / (1.0 + GAMMA)) * F.pow(F.lit(GAMMA), F.col("bin").cast("double")), F.lit(0.0))
    placed = sketch.select(*key, value.alias("value"), total.alias("total"), upto.alias("upto"))
    at = lambda q: F.min(F.when(F.col("upto") >= F.ceil(F.col("total") * q), F.col("value")))
    return placed.groupBy(*key).agg(F.max("total").alias("n"), at(0.25).alias("q1"), at(0.75).alias("q3"))


def fences(rated: DataFrame) -> DataFrame:
    """lang, source, and <rate>_low and <rate>_high of each (language, source), from all documents with words."""
    own = cut(sketches(rated, "lang", "source"), "sketches")
    by_lang = cut(merged(own, "lang"), "lang-sketches")
    corpus = quartiles(merged(by_lang), *()).select("rate", F.col("q1").alias("c1"), F.col("q3").alias("c3"))

    def drawn(own: str, other: str) -> Column:
        return (F.col("n") * F.col(own) + F.lit(PRIOR) * F.col(other)) / (F.col("n") + F.lit(PRIOR))

    langs = quartiles(by_lang, "lang").join(corpus, "rate").select(F.col("lang").alias("llang"), F.col("rate").alias("lrate"), drawn("q1", "c1").alias("l1"), drawn("q3", "c3").alias("l3"))
    groups = quartiles(own, "lang", "source").join(langs, F.col("lang").eqNullSafe(F.col("llang")) & (F.col("rate") == F.col("lrate")))
    bounds = groups.select("lang", "source", "rate", drawn("q1", "l1").alias("q1"), drawn("q3", "l3").alias("q3"))
    limits = []
    for c, (least, _, _) in FENCES.items():
        spread = F.greatest(F.col("q3") - F.col("q1"), F.lit(least)) * WIDTH
        limits += [F.max(F.when(F.col("rate") == c, F.col("q1") - spread)).alias(f"{c}_low"), F.max(F.when(F.col("rate") == c, F.col("q3") + spread)).alias(f"{c}_high")]
    return bounds.groupBy("lang", "source").agg(*limits)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """counts() with base_failed, failed_rules (names of the adaptive rules broken) and kept."""
    rated = with_rates(cut(counts(docs, id_col, text_col, lang_col, source_col), "counts"))
    limits = cut(fences(rated), "fences")
    joined = rated.alias("d").join(limits.alias("f"), F.col("d.lang").eqNullSafe(F.col("f.lang")) & F.col("d.source").eqNullSafe(F.col("f.source")), "left")
    broken = []
    for c, (_, short, lower) in FENCES.items():
        slack = F.lit(short) / F.sqrt(F.greatest(F.col("d.n_lines" if "line" in c else "d.n_words"), F.lit(1)))
        out = F.col(f"d.{c}") > F.col(f"f.{c}_high") + slack
        if lower:
            out = out | (F.col(f"d.{c}") < F.col(f"f.{c}_low") - slack)
        broken.append(F.when(out, F.lit(c)))
    base_failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED)
    return (
        joined.select("d.*", F.array_compact(F.array(*broken)).alias("failed_rules"))
        .withColumn("base_failed", base_failed)
        .withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
    )
