"""Per-task tables of words: what depends on a word alone is computed once, for all new words of a slice together."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from dossier.llm.slices import release, text_slices

SLICE_BYTES = 1_000_000
MOST_WORDS = 300_000


class WordTable:
    """Rows of numbers by word. compute(words) -> array (len(words), width). Forgets all once it holds too many."""

    def __init__(self, width: int, compute: Callable[[list[str]], np.ndarray], most: int = MOST_WORDS):
        self.width, self.compute, self.most = width, compute, most
        self.known: dict[str, int] = {}
        self.rows = np.zeros((0, width), np.float32)

    def look_up(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """The row of each word, all texts one after another, and the number of words of each text."""
        if len(self.known) > self.most:
            self.known, self.rows = {}, np.zeros((0, self.width), np.float32)
        flat = list(chain.from_iterable(texts))
        at = np.fromiter(map(self.known.get, flat, repeat(-1)), np.int64, len(flat))
        if len(missing := np.flatnonzero(at < 0)):
            absent = [flat[i] for i in missing.tolist()]
            new = list(dict.fromkeys(absent))
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            self.rows = np.concatenate((self.rows, self.compute(new).astype(np.float32)))
            at[missing] = np.fromiter(map(self.known.__getitem__, absent), np.int64, len(absent))
        return at, np.fromiter(map(len, texts), np.int64, len(texts))


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of values (n, width) over runs of the given lengths; an empty run sums to 0."""
    out = np.zeros((len(counts), values.shape[1]))
    full = counts > 0
    if full.any():
        out[full] = np.add.reduceat(values.astype(np.float64), (np.cumsum(counts) - counts)[full], axis=0)
    return out


def map_texts(df: DataFrame, text_col: str, made: list[T.StructField], work, keep_text: bool = False) -> DataFrame:
    """df, without text_col unless kept, with columns made from it: work() -> function of (texts of a slice) -> Arrow arrays."""
    kept = [c for c in df.columns if (keep_text or c != text_col) and c not in {f.name for f in made}]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        do = work()
        for b in batches:
            at = 0
            for part in text_slices(b.column(text_col), SLICE_BYTES):
                yield pa.RecordBatch.from_arrays([b.column(c).slice(at, len(part)) for c in kept] + do(part), names=[*kept, *[f.name for f in made]])
                at += len(part)
            release()

    return df.mapInArrow(run, T.StructType([*[df.schema[c] for c in kept], *made]))
