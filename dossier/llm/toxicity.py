"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: densities of words in a curated lexicon and in lexicons learned from labels (whole words and stems, so
that inflected forms count), their nearness to second-person words, rates of capitals, punctuation, exclamation marks,
digits and disguised spellings, and the length.

The sample of labelled rows is split into two halves by a hash of the id. Each half's features come from the lexicons of the
other half, so no row meets a lexicon that its own label shaped; four fifths of these rows train the trees (of spark.ml), the
rest gives the isotonic curve that maps their margin to a probability. Scoring uses the lexicons of both halves together.

Defined cases: a document with labels of both values counts as toxic; a very long text is read whole; columns of docs named
like a new one are replaced by it; a null or empty text has all features 0 and is scored like any other; without rows of both labels every text
scores the share of label 1 (0 without labels); texts of equal features have equal scores; repeated rows are rows of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossier.llm.common import bounded_sample, cut
from dossier.llm.word_table import WordTable, map_texts, sums

SAMPLE = 16_000
LEAST_TEXTS, LEAST_ODDS = 3, 1.5  # of the learned lexicons
LEAST_G = 16.0  # likelihood ratio statistic of a term against chance: many terms are tried
STEMS = (4, 5, 6, 7, 8)
NEAR = 5  # words between an abusive word and a second-person one
TREES, DEPTH = 20, 3
FIT_PARTS = 8  # of the sample

#: Abusive words, and second-person words, of the languages at hand.
CURATED = frozenset(
    """idiot idiots moron morons stupid dumb loser losers scum trash garbage pathetic worthless disgusting clown clowns
    imbecile fool fools jerk bastard bitch asshole shit fuck fucking damn crap slut whore retard retarded vermin filth
    idiota imbécil estúpido estúpida basura asqueroso mierda puta cabrón payaso
    idiote imbécile stupide ordure connard salope merde pute crétin abruti
    dumm dummkopf trottel arschloch scheiße hure abschaum depp ekelhaft""".split()
)
SECOND_PERSON = frozenset(
    """you your yours yourself u ur tu te ti tus usted ustedes vosotros toi ton ta tes vous votre vos
    du dich dir dein deine ihr euch euer""".split()
)
#: Characters that stand for letters in disguised spellings.
DISGUISE = str.maketrans("013457@$!|", "oieastasil")
EDGE = re.compile(r"^[\W_]+|[\W_]+$")
INNER = re.compile(r"[\W_]+")
REPEATED = re.compile(r"(.)\1{2,}")

WORD_COLUMNS = ("curated", "word_odds", "stem_odds", "abusive", "second_person", "characters", "capitals", "punctuation", "exclamation", "digits", "all_caps", "disguised", "disguised_abuse")
FEATURES = (
    "curated", "word_odds", "stem_odds", "abusive", "abusive_count", "near_second_person", "second_person", "capitals", "punctuation", "exclamation", "digits", "all_caps", "disguised", "disguised_abuse", "log_words",
)


@dataclass
class Lexicon:
    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)


def plain(word: str) -> str:
    return EDGE.sub("", word).lower()


def undisguised(word: str) -> str:
    """A spelling with look-alike characters, inner marks and drawn-out letters taken back."""
    return REPEATED.sub(r"\1", INNER.sub("", word.lower().translate(DISGUISE)))


def word_rows(words: list[str], lex: Lexicon) -> np.ndarray:
    out = np.zeros((len(words), len(WORD_COLUMNS)), np.float32)
    for i, w in enumerate(words):
        p = plain(w)
        odd = any(not c.isalpha() for c in p)
        u = undisguised(w) if odd or REPEATED.search(p) else p
        stem = max((lex.stems.get(u[:n], 0.0) for n in STEMS if len(u) >= n), default=0.0)
        known = max(lex.words.get(p, 0.0), lex.words.get(u, 0.0) if len(u) > 3 else 0.0)
        curated = p in CURATED or u in CURATED
        abusive = curated or known >= LEAST_ODDS or stem >= LEAST_ODDS
        letters = sum(map(str.isalpha, w))
        capitals = sum(map(str.isupper, w))
        disguised = odd and letters > 0 and u != p
        out[i] = (
            curated, known, stem, abusive, p in SECOND_PERSON, len(w), capitals, sum(not c.isalnum() for c in w), w.count("!"), sum(map(str.isdigit, w)),
            letters > 1 and capitals == letters, disguised, disguised and abusive,
        )
    return out


def dense(at: np.ndarray, n: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The features of each text, from the rows of its words."""
    values = rows[at]
    total = dict(zip(WORD_COLUMNS, sums(values, n).T, strict=True))
    words, characters = np.maximum(n, 1), np.maximum(total["characters"], 1)
    gap = 1000 * NEAR
    place = np.arange(len(at)) + np.repeat(np.arange(len(n)), n) * gap
    bad, you = place[values[:, 3] > 0], place[values[:, 4] > 0]
    near = np.zeros(len(n))
    if len(bad) and len(you):
        right = np.searchsorted(you, bad)
        apart = np.minimum(np.abs(bad - you[np.maximum(right - 1, 0)]), np.abs(bad - you[np.minimum(right, len(you) - 1)]))
        near += np.bincount(np.repeat(np.arange(len(n)), n)[values[:, 3] > 0], weights=apart <= NEAR, minlength=len(n))
    per_word = lambda c: total[c] / words
    per_character = lambda c: total[c] / characters
    return np.column_stack(
        [per_word(c) for c in ("curated", "word_odds", "stem_odds", "abusive")]
        + [np.minimum(total["abusive"], 10), near / words, per_word("second_person")]
        + [per_character(c) for c in ("capitals", "punctuation", "exclamation", "digits")]
        + [per_word(c) for c in ("all_caps", "disguised", "disguised_abuse")]
        + [np.log1p(n)]
    )


def featurize(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", out_col: str = "features") -> DataFrame:
    """docs without text_col, with out_col: array<double> in the order of FEATURES."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def work():
        lex: Lexicon = shared.value
        table = WordTable(len(WORD_COLUMNS), lambda words: word_rows(words, lex))

        def do(texts: list[str]) -> list[pa.Array]:
            x = dense(*table.look_up([t.split() for t in texts]), table.rows)
            return [pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(FEATURES), pa.int32()), pa.array(x.ravel(), pa.float64()))]

        return do

    return map_texts(docs, text_col, [T.StructField(out_col, T.ArrayType(T.DoubleType()))], work)


def learn_lexicons(labelled: DataFrame) -> list[Lexicon]:
    """Words and stems whose log odds between the labels stand out, from rows of text, label and half (0 or 1): the lexicons
    of either half and of both together, from one pass."""

    def work():
        def do(texts: list[str]) -> list[pa.Array]:
            out = []
            for t in texts:
                words = {p for p in map(plain, set(t.split())) if p}
                out.append([*words, *{f"{p[:n]}*" for p in words for n in STEMS if len(p) >= n}])
            return [pa.array(out, pa.list_(pa.string()))]

        return do

    counts = [F.count_if((F.col("label") == y) & (F.col("half") == h)).alias(f"k{y}{h}") for y in (0, 1) for h in (0, 1)]
    n = labelled.agg(*counts).first()
    terms = map_texts(labelled.select("label", "half", "text"), "text", [T.StructField("terms", T.ArrayType(T.StringType()))], work)
    counted = cut(terms.select("label", "half", F.explode("terms").alias("term")).groupBy("term").agg(*counts).filter(f"k10 + k11 >= {LEAST_TEXTS}"), "terms")

    def lexicon(halves: tuple[int, ...]) -> Lexicon:
        k1, k0 = (sum(F.col(f"k{y}{h}") for h in halves) for y in (1, 0))
        n1, n0 = (sum(n[f"k{y}{h}"] for h in halves) for y in (1, 0))
        odds = F.log((k1 + 0.5) / (n1 + 1.0)) - F.log((k0 + 0.5) / (n0 + 1.0))
        share = n1 / max(n1 + n0, 1)
        against = lambda k, of: F.when(k > 0, k * F.log(k / ((k1 + k0) * max(of, 1e-9)))).otherwise(0.0)
        g = 2 * (against(k1, share) + against(k0, 1 - share))
        kept = counted.withColumns({"k1": k1, "odds": odds, "g": F.round(g, 6)}).filter((F.col("k1") >= LEAST_TEXTS) & (F.col("odds") >= LEAST_ODDS) & (F.col("g") >= LEAST_G))
        rows = kept.select("term", "odds").collect()  # all that stand out; the sample bounds their number
        return Lexicon({r.term: r.odds for r in rows if not r.term.endswith("*")}, {r.term[:-1]: r.odds for r in rows if r.term.endswith("*")})

    return [lexicon((0,)), lexicon((1,)), lexicon((0, 1))]


@dataclass
class Model:
    lexicon: Lexicon
    trees: GBTClassificationModel | None
    curve: IsotonicRegressionModel | None
    prior: float


def learn(docs: DataFrame, labels: DataFrame, text_col: str = "text", label_col: str = "toxic", id_col: str = "doc_id", sample: int = SAMPLE) -> Model:
    """A model of the labelled rows of docs, from a bounded sample of them."""
    known = labels.filter(F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.max(label_col).cast("int").alias("label"))
    taken = bounded_sample(known, sample, F.col(id_col))
    part = F.pmod(F.xxhash64(F.col(id_col), F.lit(11)), F.lit(20))
    rows = cut(docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(taken, id_col).select("text", "label", part.alias("part"), (part % 2).alias("half")), "labelled")
    n, ones = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    prior = ones / n if n else 0.0
    first, second, lexicon = learn_lexicons(rows)
    # by a hash of the rows: the sample may lie in a few of the table's files
    spread = cut(rows.repartition(FIT_PARTS, F.xxhash64("text", "part")), "spread")
    halves = [featurize(spread.filter(F.col("half") == h), other) for h, other in ((0, second), (1, first))]
    seen = cut(halves[0].unionByName(halves[1]).select("part", "label", array_to_vector("features").alias("features")), "features")
    if seen.select("label").distinct().count() < 2:
        return Model(lexicon, None, None, prior)
    to_fit, to_calibrate = seen.filter("part < 16"), seen.filter("part >= 16")
    if min(d.filter(f"label = {y}").count() for d in (to_fit, to_calibrate) for y in (0, 1)) < 5:
        to_fit = to_calibrate = seen  # too few rows to hold some back
    to_fit = to_fit.cache()
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=5, minInstancesPerNode=2, labelCol="label").fit(to_fit)
    margin = trees.transform(to_calibrate).select(vector_to_array("rawPrediction")[1].alias("margin"), F.col("label").cast("double").alias("label"))
    curve = IsotonicRegression(featuresCol="margin", labelCol="label").fit(margin)
    to_fit.unpersist()
    return Model(lexicon, trees, curve, prior)


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs without text_col, with the calibrated probability of label 1."""
    if model.trees is None or model.curve is None:
        return docs.drop(text_col).withColumn(score_col, F.lit(float(model.prior)))
    inner = docs.select(F.struct(*[F.col(c) for c in docs.columns if c != text_col]).alias("row"), F.col(text_col).alias("text"))
    vectors = featurize(inner, model.lexicon, "text").select("row", array_to_vector("features").alias("features"))
    margin = model.trees.transform(vectors).select("row", vector_to_array("rawPrediction")[1].alias("margin"))
    calibrated = model.curve.setFeaturesCol("margin").transform(margin)
    return calibrated.select("row.*", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("prediction"))).alias(score_col))
