"""Measures of retrieval, citations and answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.cuts import cut

CITATION_SHARE, GROUNDING_SHARE = 0.65, 0.35
LONG_ANSWER = 400
MOST_INVALID = 0.5
CHUNK_ID_LENGTH = 12


def ranked_metrics(hits: DataFrame, relevant: DataFrame, question: str = "question_id", item: str = "chunk_id", rank: str = "rank") -> DataFrame:
    """Per question with relevant items: recall at 5, 10 and 20, MRR within 20 and nDCG at 10.

    hits: question, item, rank from 1; relevant: question, item.
    """
    wanted = relevant.select(question, item).distinct()
    totals = wanted.groupBy(question).agg(F.count("*").alias("n_relevant"))
    marked = hits.select(question, item, rank).join(wanted, [question, item]).groupBy(question).agg(
        *[F.sum((F.col(rank) <= k).cast("int")).alias(f"hits_{k}") for k in (5, 10, 20)],
        F.min(F.when(F.col(rank) <= 20, F.col(rank))).alias("first"),
        F.sum(F.when(F.col(rank) <= 10, 1.0 / F.log2(F.col(rank) + 1.0))).alias("dcg"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_relevant"), F.lit(10)).cast("int")), F.lit(0.0), lambda a, i: a + 1.0 / F.log2(i + 1.0))
    zero = F.lit(0.0)
    return totals.join(marked, question, "left").select(
        question,
        *[F.coalesce(F.col(f"hits_{k}") / F.col("n_relevant"), zero).alias(f"recall_at_{k}") for k in (5, 10, 20)],
        F.coalesce(1.0 / F.col("first"), zero).alias("mrr"),
        F.coalesce(F.col("dcg") / ideal, zero).alias("ndcg_at_10"),
    )


def exclusive_decile(values: Column) -> Column:
    """First decile by the exclusive method from a sorted array; the least of under 10 values."""
    n = F.size(values)
    j = F.greatest(F.lit(1), F.least(F.floor((n + 1) / 10).cast("int"), n - 1))
    delta = (n + 1) - j * 10
    return F.when(n >= 10, (F.get(values, j - 1) * (10 - delta) + F.get(values, j) * delta) / 10).otherwise(F.array_min(values))


def values_at(rows: DataFrame, value: str, by: list[str], ranks: dict[str, Callable[[Column], Column]], ranges: int = 128, salts: int = 16) -> DataFrame:
    """by, one column for each of ranks: the value at that place, from 0, among a group's n values that are not null.

    Equal values are counted first. A group's different values lie in about `ranges` ranges of equal numbers; only those of
    the ranges that hold a wanted place are ordered, so no group is collected or ordered whole.
    """
    per = rows.filter(F.col(value).isNotNull()).groupBy(F.struct(F.lit(0), *by).alias("_key"), F.col(value).alias("_v")).agg(F.count("*").alias("_m"))
    shares = [i / ranges for i in range(1, ranges)]
    group = cut(per.groupBy("_key").agg(F.percentile_approx("_v", shares, 1000).alias("_bounds"), F.sum("_m").alias("_n")), "bounds")
    spread = group.select("_key", "_bounds", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    salted = per.withColumn("_salt", F.pmod(F.xxhash64("_v"), F.lit(salts)).cast("int")).join(spread, ["_key", "_salt"])
    ranged = salted.select("_key", "_v", "_m", F.size(F.filter("_bounds", lambda b: b < F.col("_v"))).alias("_range"))
    counts = ranged.groupBy("_key", "_range").agg(F.sum("_m").alias("_held"))
    counts = counts.withColumn("_end", F.sum("_held").over(Window.partitionBy("_key").orderBy("_range")))
    asked = group.select("_key", F.explode(F.array(*[F.struct(F.lit(name).alias("name"), rank(F.col("_n")).cast("bigint").alias("rank")) for name, rank in ranks.items()])).alias("_w"))
    hit = counts.join(asked, "_key").filter((F.col("_w.rank") >= F.col("_end") - F.col("_held")) & (F.col("_w.rank") < F.col("_end")))
    held = hit.groupBy("_key", "_range").agg(F.first(F.col("_end") - F.col("_held")).alias("_before"), F.collect_list("_w").alias("_wanted"))
    upto = F.col("_before") + F.sum("_m").over(Window.partitionBy("_key", "_range").orderBy("_v"))
    placed = ranged.join(held, ["_key", "_range"]).withColumn("_upto", upto).select("_key", "_v", "_m", "_upto", F.explode("_wanted").alias("_w"))
    found = placed.filter((F.col("_w.rank") >= F.col("_upto") - F.col("_m")) & (F.col("_w.rank") < F.col("_upto")))
    return found.groupBy("_key").agg(*[F.max(F.when(F.col("_w.name") == name, F.col("_v"))).alias(name) for name in ranks])


MEDIAN = {"lower": lambda n: F.floor((n - 1) / 2), "upper": lambda n: F.floor(n / 2)}


def summary(scores: DataFrame, score: str = "overall", by: list[str] | None = None) -> DataFrame:
    """Number, mean, median and first decile of a score."""
    by = by or []
    j = lambda n: F.greatest(F.lit(1), F.least(F.floor((n + 1) / 10), n - 1))
    ranks = MEDIAN | {"low": lambda n: F.when(n >= 10, j(n) - 1).otherwise(0), "high": lambda n: F.when(n >= 10, j(n)).otherwise(0)}
    at = values_at(scores, score, by, ranks)
    grouped = scores.groupBy(*by).agg(F.count(score).alias("scored"), F.avg(score).alias("mean")).withColumn("_key", F.struct(F.lit(0), *by)).join(at, "_key", "left")
    n = F.col("scored")
    delta = (n + 1) - j(n) * 10
    decile = F.when(n >= 10, (F.col("low") * (10 - delta) + F.col("high") * delta) / 10).otherwise(F.col("low"))
    return grouped.select(*by, "scored", F.round("mean", 4).alias("mean"), F.round((F.col("lower") + F.col("upper")) / 2, 4).alias("p50"), F.round(decile, 4).alias("p10"))


def nearest_rank(values: Column, share: float) -> Column:
    """The value at index floor(n * share) of a sorted array, the last at most."""
    n = F.size(values)
    return F.get(values, F.least(F.floor(n * share).cast("int"), n - 1))


def validate_citations(answers: DataFrame, retrieved: DataFrame, found: Column, question: str = "question_id") -> DataFrame:
    """One row per different citation of an answer: position, chunk_id, valid.

    found: array of cited ids in order; retrieved: question, chunk_id and more. Valid ids have CHUNK_ID_LENGTH characters and
    were retrieved for the question.
    """
    cited = answers.select(question, F.posexplode(found).alias("position", "chunk_id"))
    once = cited.groupBy(question, "chunk_id").agg(F.min("position").alias("position"))
    marked = once.join(retrieved.withColumn("_found", F.lit(True)), [question, "chunk_id"], "left")
    return marked.withColumn("valid", F.col("_found").isNotNull() & (F.length("chunk_id") == CHUNK_ID_LENGTH)).drop("_found")


def citation_totals(answers: DataFrame, validated: DataFrame, found: Column, question: str = "question_id") -> DataFrame:
    """Per answer: all citations, different valid and invalid ones, and whether over half of all are invalid."""
    counts = validated.groupBy(question).agg(F.count_if("valid").alias("n_valid"), F.count_if(~F.col("valid")).alias("n_invalid"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return answers.select(question, F.size(found).alias("n_found")).join(counts, question, "left").select(
        question, "n_found", zero("n_valid").alias("n_valid"), zero("n_invalid").alias("n_invalid"),
        F.coalesce(F.col("n_invalid") / F.col("n_found") > MOST_INVALID, F.lit(False)).alias("needs_retry"),
    )


def format_violations(response: Column, cited: Column, disclaims: Column, narrative: Column, markers: list[str]) -> Column:
    """Names of broken format rules, each once."""
    structured = F.lit(False)
    for m in markers:
        structured = structured | F.contains(response, F.lit(m))
    strict = ~narrative & ~disclaims
    headless = strict & cited & (~structured | (F.contains(response, F.lit("Based on your query")) & ~F.contains(response, F.lit("Component:")) & ~F.contains(response, F.lit("Most Relevant Solution"))))
    bare = (F.length(response) > LONG_ANSWER) & ~cited & ~disclaims
    return F.array_compact(F.array(F.when(headless, "missing Component header"), F.when(bare, "no citations despite long response")))


def overall(valid_share: Column, grounding: Column, refused_rightly: Column) -> Column:
    return F.when(refused_rightly, F.lit(1.0)).otherwise(F.round(CITATION_SHARE * valid_share + GROUNDING_SHARE * grounding, 4))


def grid_sweep(similar: DataFrame, thresholds: DataFrame, most: DataFrame, by: str = "question_id") -> DataFrame:
    """Per (threshold, k): share of questions with a match, and matches per question.

    similar: question, item, similarity; thresholds: threshold; most: k. The grid is a few cells; each row of similar is
    ranked once and then meets the cells that take it.
    """
    ranked = similar.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("similarity"), "item")))
    cells = thresholds.join(most, F.lit(True))
    n = similar.select(F.count_distinct(by).alias("n"))
    taken = ranked.join(cells, (F.col("similarity") >= F.col("threshold")) & (F.col("_n") <= F.col("k")))
    per = taken.groupBy("threshold", "k", by).agg(F.count("*").alias("m"))
    totals = per.groupBy("threshold", "k").agg(F.count("*").alias("matched"), F.sum("m").alias("items"))
    return cells.join(totals, ["threshold", "k"], "left").join(n, F.lit(True)).select(
        "threshold", "k", F.coalesce(F.col("matched") / F.col("n"), F.lit(0.0)).alias("match_rate"), F.coalesce(F.col("items") / F.col("n"), F.lit(0.0)).alias("items_per_question")
    )


#: Words that say nothing of a text's subject.
STOP_WORDS = "a an and are as at be been but by for from had has have he her his i if in is it its not of on or she so that the their them they this to was we were which will with you your".split()


def tfidf_cosine(pairs: DataFrame, key: str, a: str = "a", b: str = "b", grams: int = 2) -> DataFrame:
    """key, similarity of two texts: cosine of tf-idf over word 1- to 2-grams, with idf = ln(3 / (1 + texts)) + 1.

    Terms are counted relationally: (key, side, term) is grouped before it is joined, so long texts cost rows, not memory.
    """
    words = lambda c: F.filter(F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\b\w\w+\b"), F.lit(0)), lambda w: ~w.isin(STOP_WORDS))

    def terms(c: str):
        w = words(F.col(c))
        pairs_ = F.when(F.size(w) > 1, F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w)), lambda x, y: F.concat_ws(" ", x, y))).otherwise(F.array().cast("array<string>"))
        return F.concat(w, pairs_) if grams > 1 else w

    side = lambda c: pairs.select(key, F.explode(terms(c)).alias("term")).groupBy(key, "term").agg(F.count("*").alias(f"n_{c}"))
    both = side(a).join(side(b), [key, "term"], "full_outer").fillna(0, [f"n_{a}", f"n_{b}"])
    idf = F.when((F.col(f"n_{a}") > 0) & (F.col(f"n_{b}") > 0), 1.0).otherwise(F.log(F.lit(1.5)) + 1.0)
    x, y = F.col(f"n_{a}") * idf, F.col(f"n_{b}") * idf
    sums = both.groupBy(key).agg(F.sum(x * y).alias("xy"), F.sum(x * x).alias("xx"), F.sum(y * y).alias("yy"))
    return pairs.select(key).join(sums, key, "left").select(key, F.coalesce(F.try_divide("xy", F.sqrt("xx") * F.sqrt("yy")), F.lit(0.0)).alias("similarity"))


def indexed_citations(validated: DataFrame, title: str = "source_title", question: str = "question_id") -> DataFrame:
    """The valid citations with index: 1 for the source cited first, 2 for the next; sources without a title share one."""
    from dossier.operators.windows import first_seen_index

    named = validated.filter("valid").withColumn("_title", F.coalesce(F.col(title), F.lit("Unknown Source")))
    return first_seen_index(named, [question], "_title", "position").drop("_title")
