"""Language ID by word-first backoff.

A known word scores by its log frequency in each language; an unseen word by the longest known character n-gram at each
of its positions, from MAX_GRAM characters down to one. The language of the greatest sum over all words of the text wins,
and the softmax of the sums, tempered by the text's length, is its score.

Counts are distributed group-bys over a sample of at most SAMPLE labelled documents of each language, so a rare language is
learned as well as a hot one. The model holds at most MOST_WORDS words and MOST_GRAMS n-grams, the most frequent ones of each
language in turn: these bound the size of what is broadcast, not what is read, as a word that is left out is scored
by its n-grams and an n-gram that is left out by a shorter one. All n-grams of all words are counted, however long the word.

Defined cases: a text that is null or has no letter (Unicode category L) is `und` with score 0; nothing learned (no labelled
rows) makes every text `und`; languages of equal score go to the one first in code point order; a very long text is scored
whole, with memory in proportion to it; repeated rows are rows of their own; columns of docs named like a new one are replaced
by it; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossier.llm.common import cut, in_sample
from dossier.llm.word_table import WordTable, map_texts, sums

SAMPLE, MOST_WORDS, MOST_GRAMS = 3_000, 60_000, 60_000
MAX_GRAM = 4
LEAST_SEEN = 2  # a term seen once tells no frequency: it is backed off like an unseen one
SMOOTH = 0.5
#: Runs of letters, and of numbers that are no digits (fractions, circled numbers), which the class of word characters also
#: holds; texts with such numbers are split by the second, slower pattern.
NEARLY, LETTERS = re.compile(r"[^\W\d_]+"), regex.compile(r"\p{L}+")
UNKNOWN = "und"
EVIDENCE = 8.0  # a text's words count as so many at most in its score


@dataclass
class Model:
    langs: list[str]
    words: dict[str, int]
    word_scores: np.ndarray  # (words, langs): log frequencies
    grams: dict[str, int]
    gram_scores: np.ndarray  # the last row: unknown characters


def letter_runs(text: str) -> list[str]:
    words = NEARLY.findall(text)
    return words if "".join(words).isalpha() else LETTERS.findall(text)


def grams_of(word: str) -> list[str]:
    w = f"^{word}$"
    return [w[i : i + n] for n in range(1, MAX_GRAM + 1) for i in range(len(w) - n + 1)]


def _table(rows: pa.Table, langs: list[str]) -> tuple[dict[str, int], np.ndarray]:
    """The place of each term and its log frequencies; rows: term, lang, n."""
    terms = rows["term"].combine_chunks().dictionary_encode()
    at = rows["lang"].combine_chunks().dictionary_encode()
    place = np.array([langs.index(x) for x in at.dictionary.to_pylist()], np.int64)
    counts = np.zeros((len(terms.dictionary) + 1, len(langs)))
    if len(rows):
        counts[terms.indices.to_numpy(), place[at.indices.to_numpy()]] = rows["n"].to_numpy()
    totals = np.maximum(counts.sum(axis=0), 1)
    # one floor for all languages: what none was seen of must not speak for the language of fewest rows
    scores = np.log(counts / totals + SMOOTH / totals.mean()).astype(np.float32) if langs else counts.astype(np.float32)
    return {t: i for i, t in enumerate(terms.dictionary.to_pylist())}, scores


def most_frequent(counted: DataFrame, bound: int) -> pa.Table:
    """term, lang, n of `bound` terms seen LEAST_SEEN times: the most frequent ones of each language in turn."""
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "term"))
    first = counted.withColumn("place", place).groupBy("term").agg(F.min("place").alias("place"), F.sum("n").alias("total"))
    top = first.filter(F.col("total") >= LEAST_SEEN).orderBy("place", F.desc("total"), "term").limit(bound).select("term")
    return counted.join(top, "term").select("lang", "term", "n").toArrow().sort_by([("term", "ascending"), ("lang", "ascending")])


def learn(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample: int = SAMPLE, most_words: int = MOST_WORDS, most_grams: int = MOST_GRAMS
) -> Model:
    """A model of the labelled rows of docs (text and language not null), from about `sample` rows of each language at most."""
    labelled = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).filter("text is not null and lang is not null")
    sizes = cut(labelled.groupBy("lang").agg(F.count("*").alias("rows")), "sizes")
    taken = labelled.join(sizes, "lang").filter(in_sample(F.col("id"), sample, F.col("rows")))
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))
    counted = cut(taken.select("lang", F.explode(words).alias("term")).groupBy("lang", "term").agg(F.count("*").alias("n")), "words")
    langs = [r.lang for r in counted.select("lang").distinct().orderBy("lang").collect()]

    # characters first, then slices of them: linear in the word, however long
    letters = F.split(F.concat(F.lit("^"), F.col("term"), F.lit("$")), "")
    n_grams = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.size("letters") - n + 1, F.lit(1))), lambda i: F.array_join(F.slice("letters", i, n), ""))
    sizes = F.transform(F.sequence(F.lit(1), F.least(F.lit(MAX_GRAM), F.size("letters"))), n_grams)
    by_gram = counted.select("lang", "n", letters.alias("letters")).select("lang", "n", F.explode(F.flatten(sizes)).alias("term")).groupBy("lang", "term").agg(F.sum("n").alias("n"))
    return Model(langs, *_table(most_frequent(counted, most_words), langs), *_table(most_frequent(cut(by_gram, "grams"), most_grams), langs))


def word_rows(words: list[str], m: Model) -> np.ndarray:
    """Scores of each word in each language; the unseen ones by backoff."""
    out = np.zeros((len(words), len(m.langs)), np.float32)
    at = np.array([m.words.get(w, -1) for w in words])
    out[at >= 0] = m.word_scores[at[at >= 0]]
    unseen = np.nonzero(at < 0)[0]
    flat: list[int] = []
    counts = []
    unknown = len(m.gram_scores) - 1
    for i in unseen.tolist():
        w, began = f"^{words[i]}$", len(flat)
        for p in range(len(w)):
            for n in range(min(MAX_GRAM, len(w) - p), 0, -1):
                g = m.grams.get(w[p : p + n])
                if g is not None:
                    flat.append(g)
                    break
            else:
                flat.append(unknown)
        counts.append(len(flat) - began)
    if len(unseen):
        n = np.array(counts)
        out[unseen] = sums(m.gram_scores[np.array(flat)], n) / n[:, None]
    return out


def predict(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "score", keep_text: bool = False) -> DataFrame:
    """docs (without text_col unless kept) with the predicted language and its score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work():
        m: Model = shared.value
        table = WordTable(len(m.langs), lambda words: word_rows(words, m))

        def do(texts: list[str]) -> list[pa.Array]:
            if not m.langs:
                return [pa.array([UNKNOWN] * len(texts), pa.string()), pa.array([0.0] * len(texts))]
            at, n = table.look_up([letter_runs(t.lower()) for t in texts])
            mean = sums(table.rows[at], n) / np.maximum(n, 1)[:, None]
            mean = mean * np.minimum(n, EVIDENCE)[:, None]
            odds = np.exp(mean - mean.max(axis=1, keepdims=True))
            best = odds.argmax(axis=1)
            score = np.where(n > 0, 1.0 / odds.sum(axis=1), 0.0)
            return [pa.array([m.langs[b] if k else UNKNOWN for b, k in zip(best, n, strict=True)], pa.string()), pa.array(score, pa.float64())]

        return do

    return map_texts(docs, text_col, [T.StructField(lang_col, T.StringType()), T.StructField(score_col, T.DoubleType())], work, keep_text)


def identified(docs: DataFrame, model: Model, least_score: float = 0.4, text_col: str = "text") -> DataFrame:
    """docs, all columns, without the rows whose language is not told: `und`, or a score under least_score."""
    lang, score = (next(n for n in (base, *(f"{base}_{i}" for i in range(len(docs.columns) + 1))) if n not in docs.columns) for base in ("lang_pred", "lang_score"))
    told = predict(docs, model, text_col, lang, score, keep_text=True)
    return told.filter((F.col(lang) != UNKNOWN) & (F.col(score) >= least_score)).select(*docs.columns)
