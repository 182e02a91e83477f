"""Finding registered names in texts, and candidates for names that the register lacks."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from dossier.cuts import cut

#: Characters of names in one automaton.
REGISTER_CHARS = 2_000_000


def lookup(register: DataFrame, id_col: str = "id", name: str = "name", aliases: str = "aliases") -> DataFrame:
    """term, id: lowercase names; a primary name wins over any alias, then the smaller id."""
    clean = lambda c: F.lower(F.trim(c))
    primary = register.select(clean(F.col(name)).alias("term"), F.col(id_col).alias("id"), F.lit(0).alias("order"))
    other = register.select(F.explode(aliases).alias("alias"), F.col(id_col).alias("id")).select(clean(F.col("alias")).alias("term"), "id", F.lit(1).alias("order"))
    first = Window.partitionBy("term").orderBy("order", "id")
    return primary.unionByName(other).filter("term <> ''").withColumn("_n", F.row_number().over(first)).filter("_n = 1").select("term", "id")


class WordAutomaton:
    """Finds all names in a run of words at once: a trie of the names' words with failure links."""

    def __init__(self, names: list[tuple[str, list]]):
        """names: (words joined by spaces, ids)."""
        self.after: list[dict[str, int]] = [{}]
        self.found: list[tuple] = [()]
        for name, ids in names:
            at = 0
            for word in name.split(" "):
                to = self.after[at].get(word)
                if to is None:
                    to = self.after[at][word] = len(self.after)
                    self.after.append({})
                    self.found.append(())
                at = to
            self.found[at] = (*self.found[at], *ids)
        self.fall = [0] * len(self.after)
        reached = list(self.after[0].values())
        for at in reached:  # breadth first; grows while it is walked
            for word, to in self.after[at].items():
                reached.append(to)
                back = self.fall[at]
                while back and word not in self.after[back]:
                    back = self.fall[back]
                self.fall[to] = self.after[back].get(word, 0)
                self.found[to] = (*self.found[to], *self.found[self.fall[to]])

    def ids(self, words: list[str]) -> set:
        """Ids of all names that stand among the words."""
        after, fall, found, out, at = self.after, self.fall, self.found, set(), 0
        if self.after[0].keys().isdisjoint(words):
            return out
        for word in words:
            to = after[at].get(word)
            while to is None and at:
                at = fall[at]
                to = after[at].get(word)
            at = to or 0
            if found[at]:
                out.update(found[at])
        return out


def mentions(texts: DataFrame, terms: DataFrame, key: str, text: str) -> DataFrame:
    """key, id of every registered name, of any number of words, that stands in a text as whole words.

    Names and texts are split into words alike. An automaton of the names is built once for a task, and each text streams past it where
    it lies: nothing but pairs of key and id is shuffled. A register of over REGISTER_CHARS is split by a hash of the
    name into as many automata as that takes, and texts are read once for each.
    """
    split = lambda c: F.array_join(F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\w+"), F.lit(0)), " ")
    names = terms.select(split(F.col("term")).alias("name"), "id").filter("name <> ''").groupBy("name").agg(F.collect_set("id").alias("ids"))
    names = cut(names, "register")
    parts = max(1, -(-(names.agg(F.sum(F.length("name") + F.size("ids"))).first()[0] or 0) // REGISTER_CHARS))
    words = texts.select(key, split(F.col(text)).alias("_words"))
    schema = T.StructType([texts.schema[key], T.StructField("id", terms.schema["id"].dataType)])
    part = F.pmod(F.xxhash64("name"), F.lit(parts))
    found = [words.mapInArrow(_searching(names.filter(part == k).collect(), key, schema), schema) for k in range(parts)]
    return reduce(DataFrame.unionByName, found).distinct()


def _searching(rows: list, key: str, schema: T.StructType):
    """The search of one automaton; rows: name, ids of a part of the register, of bounded size."""
    names = [(r.name, list(r.ids)) for r in rows]
    kinds = to_arrow_schema(schema)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = WordAutomaton(names)
        for b in batches:
            rows, ids = [], []
            for i, words in enumerate(b.column("_words").to_pylist()):
                if words and (here := automaton.ids(words.split(" "))):
                    rows.extend([i] * len(here))
                    ids.extend(here)
            if rows:
                yield pa.RecordBatch.from_arrays([b.column(key).take(pa.array(rows)).cast(kinds.field(0).type), pa.array(ids, kinds.field(1).type)], schema=kinds)

    return search


def attributes(found: DataFrame, register: DataFrame, key: str, columns: list[str], id_col: str = "id") -> DataFrame:
    """Per key: sorted ids and, for each column, its sorted different values."""
    joined = found.join(register.select(F.col(id_col).alias("id"), *columns), "id")
    return joined.groupBy(key).agg(F.array_sort(F.collect_set("id")).alias("ids"), *[F.array_sort(F.collect_set(c)).alias(f"{c}s") for c in columns])


def closest(candidates: DataFrame, terms: DataFrame, least: float = 0.88, name: str = "candidate") -> DataFrame:
    """The most similar term of each candidate by edit distance: candidate, term, ratio >= least.

    Terms meet candidates by equality of length, over the lengths with which the ratio could be reached.
    """
    la, lb = F.length(name), F.length("term")
    lengths = F.sequence(F.ceil(la * least).cast("int"), F.floor(la / least).cast("int"))
    a = candidates.select(name).distinct().withColumn("_length", F.explode(lengths))
    ratio = 1.0 - F.levenshtein(F.col(name), F.col("term")) / F.greatest(la, lb)
    near = a.join(terms.select("term", lb.alias("_length")), "_length").drop("_length").withColumn("ratio", ratio).filter(F.col("ratio") >= least)
    best = Window.partitionBy(name).orderBy(F.desc("ratio"), "term")
    return near.withColumn("_n", F.row_number().over(best)).filter("_n = 1").drop("_n")


def ratio(a: str, b: str) -> float:
    """Twice the characters in matching blocks (the longest common one, then those left and right of it) by all characters."""
    return SequenceMatcher(None, a, b).ratio()


def closest_by_blocks(candidates: DataFrame, terms: DataFrame, least: float = 0.88, name: str = "candidate") -> DataFrame:
    """The term of each candidate with the largest ratio of matching blocks >= least (ties: the larger term): candidate, term, ratio.

    Matching blocks are an alignment, so a pair of ratio r has at most (1 - r) * (length + length) characters outside it; each of
    these breaks at most q of a name's padded q-grams. Each name therefore brings only its rarest q-grams, one more than can break,
    and pairs meet by these: alike in length, and at places no further apart than the characters outside. Only such pairs are scored.
    """
    if least <= 2 / 3:
        raise ValueError("A ratio of two thirds or less lets names of one length share no q-gram.")
    q = 2 if least >= 0.8 else 1
    pad = "\u0001" * (q - 1)
    grams = lambda c: F.transform(F.sequence(F.lit(1), F.length(c) + q - 1), lambda i: F.struct(F.substring(F.concat(F.lit(pad), c, F.lit(pad)), i, F.lit(q)).alias("gram"), i.alias("at")))
    outside = lambda n: F.floor(n * 2 * (1 - least) / least + 1e-9)
    a, b = (df.select(F.col(c).alias("name")).filter("name <> ''").distinct() for df, c in ((candidates, name), (terms, "term")))
    b = cut(b, "terms")
    rarity = b.select(F.explode(F.array_distinct(F.transform(grams(F.col("name")), lambda x: x["gram"]))).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))

    def prefixes(names: DataFrame, side: str) -> DataFrame:
        each = names.select("name", F.explode(grams(F.col("name"))).alias("x")).select("name", "x.*").join(rarity, "gram", "left")
        order = F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram", "at")))
        held = each.groupBy("name").agg(order.alias("grams")).withColumn("length", F.length("name"))
        first = F.slice("grams", F.lit(1), (outside(F.col("length")) * q + 1).cast("int"))
        return held.select(F.col("name").alias(side), F.col("length").alias(f"{side}_length"), F.explode(first).alias("x")).select(side, f"{side}_length", F.col("x.gram").alias("gram"), F.col("x.at").alias(f"{side}_at"))

    met = prefixes(a, "candidate").join(prefixes(b, "term"), "gram")
    longer, shorter = F.greatest("candidate_length", "term_length"), F.least("candidate_length", "term_length")
    broken = F.floor((1 - least) * (F.col("candidate_length") + F.col("term_length")) + 1e-9)
    near = met.filter((2 * shorter >= least * (longer + shorter) - 1e-9) & (F.abs(F.col("candidate_at") - F.col("term_at")) <= broken)).select("candidate", "term").distinct()

    @F.pandas_udf("score double, shown double")
    def scored(candidate: pd.Series, term: pd.Series) -> pd.DataFrame:
        pairs = list(zip(candidate, term, strict=True))
        return pd.DataFrame({"score": [ratio(t, c) for c, t in pairs], "shown": [ratio(c, t) for c, t in pairs]}, dtype="float64")

    # a ratio may depend on the order of the two: the term leads in choosing, the candidate in what is shown
    judged = near.withColumn("r", scored("candidate", "term")).filter(F.col("r.score") >= least)
    best = judged.groupBy("candidate").agg(F.max(F.struct("r.score", "term", "r.shown")).alias("best"))
    return best.select(F.col("candidate").alias(name), F.col("best.term").alias("term"), F.col("best.shown").alias("ratio"))


#: What precedes a name in running text.
CANDIDATE_PATTERNS = (r"\bM/?[VT]\.?\s+([A-Z][A-Za-z]+(?:\s[A-Z][A-Za-z]+){0,2})", r"(?i:vessel|ship)[: ]+([A-Z][A-Za-z]+(?:\s[A-Z][A-Za-z]+){0,2})", r"\"([A-Z][A-Z]+(?:\s[A-Z]+){0,2})\"")
#: Words that begin or end no name: what surrounds one in running text.
STOP_WORDS = frozenset("THE AND FOR WITH FROM THIS THAT WAS HAS HAVE WILL NAME OWNER MASTER CREW PORT DATE CALL CLASS TYPE FLAG REPORT SUBJECT".split())


def candidates(text: Column) -> Column:
    """Different uppercase candidates for names in a text, without stop words at either end."""
    found = [F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in CANDIDATE_PATTERNS]
    stop = "|".join(sorted(STOP_WORDS))
    bare = lambda x: F.regexp_replace(F.upper(F.trim(x)), rf"^(?:(?:{stop})(?:\s+|$))+|(?:\s+(?:{stop}))+$", "")
    return F.array_distinct(F.filter(F.transform(F.concat(*found), bare), lambda x: x != ""))


def unknown(found: DataFrame, terms: DataFrame, name: str = "candidate") -> DataFrame:
    """Candidates that are neither a term nor a term with a suffix.

    A candidate's beginnings of 1, 2, ... words are looked up among the terms by equality, so no word is a join key alone.
    """
    known = terms.select(F.col("term").alias("_begin")).distinct()
    words = F.split(F.lower(name), " ")
    begins = F.transform(F.sequence(F.lit(1), F.size("_words")), lambda n: F.array_join(F.slice("_words", 1, n), " "))
    each = found.select(name).distinct().withColumn("_words", words).select(name, F.explode(begins).alias("_begin"))
    return found.join(each.join(known, "_begin", "left_semi").select(name).distinct(), name, "left_anti")
