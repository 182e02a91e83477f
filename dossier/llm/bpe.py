"""Byte-level BPE encoding and decoding with a pair occurrence index.

The new distinct pieces of a slice of texts are encoded together: their bytes form one linked list of symbols, an index
maps each mergeable pair (by its rank) to all its positions, ranks are applied in ascending order to all positions at
once, and the lists of the pairs that a merge makes are extended. Pieces are remembered per task, in a table of bounded
size, so a piece costs one lookup when met again.

Texts are cut into pieces as the vocabulary's own pre-tokenizer does; the special token's string is its id wherever it
occurs. Decoding joins the tokens' bytes; bytes that are not UTF-8 become U+FFFD.

Defined cases: a null text is an empty one and has no tokens; texts are encoded whole, whatever their length; pairs of equal rank are
merged from the left; repeated rows are rows of their own; an empty table gives an empty result; further columns are kept, but those
named as a column made here are replaced by it.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossier.llm.slices import release, text_slices

#: Fixed value: the pre-tokenizer's pattern.
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: A space between two other characters: what follows it never depends on what precedes it.
APART = regex.compile(r"(?<=\S) (?=\S)")
#: White space other than the space and the line feed.
ODD_SPACE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
ENDINGS = frozenset(".,;:!?")
NONE = np.iinfo(np.int32).max
TABLE_BITS = 18  # of the table of pairs
SLICE_BYTES = 2_000_000  # of text held as pieces at a time
MOST_PIECES = 400_000  # remembered per task
ROWS = 1000  # in an output batch


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Token bytes by id, the id of each byte, and the merges as sorted pair codes with their ranks."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            raw = json.load(f)
        as_byte, ids = byte_symbols(), raw["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in raw["added_tokens"]}
        size = max([*ids.values(), *self.special.values()]) + 1
        self.tokens: list[bytes] = [b""] * size
        for token, i in ids.items():
            self.tokens[i] = bytes(as_byte[c] for c in token)
        for token, i in self.special.items():
            self.tokens[i] = token.encode()
        self.of_byte = np.zeros(256, np.int32)
        for c, b in as_byte.items():
            self.of_byte[b] = ids[c]
        merges = [m.split(" ") if isinstance(m, str) else m for m in raw["model"]["merges"]]
        left, right = (np.array([ids[m[k]] for m in merges], np.int64) for k in (0, 1))
        self.size, self.left, self.right = size, left, right
        self.made = np.array([ids[a + b] for a, b in merges], np.int32)
        self.hash_pairs(left * size + right)
        self.arrow = pa.array(self.tokens, pa.binary())
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    def hash_pairs(self, codes: np.ndarray) -> None:
        """A table with linear probing, of which `probes` steps find any pair."""
        keys, values = np.full(1 << TABLE_BITS, -1, np.int64), np.full(1 << TABLE_BITS, NONE, np.int32)
        rest, step = np.arange(len(codes)), 0
        while len(rest):
            slot = (self.slots(codes[rest]) + step) & (len(keys) - 1)
            first = np.unique(slot, return_index=True)[1]
            first = first[keys[slot[first]] < 0]
            keys[slot[first]], values[slot[first]] = codes[rest[first]], rest[first]
            rest, step = np.delete(rest, first), step + 1
        self.keys, self.values, self.probes = keys, values, step

    @staticmethod
    def slots(codes: np.ndarray) -> np.ndarray:
        return ((codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of token ids; NONE where they do not merge."""
        code = left.astype(np.int64) * self.size + right
        slot = self.slots(code)
        found = self.keys[slot]
        out = np.where(found == code, self.values[slot], NONE)
        rest = np.flatnonzero((found != code) & (found >= 0))
        for step in range(1, self.probes):
            if not len(rest):
                break
            at = (slot[rest] + step) & (len(self.keys) - 1)
            found = self.keys[at]
            hit = found == code[rest]
            out[rest[hit]] = self.values[at[hit]]
            rest = rest[~hit & (found >= 0)]
        return out


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def merge_all(pieces: list[bytes], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all pieces, one after another, and the number of ids of each piece."""
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    symbols = v.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
    n, ends = len(symbols), np.cumsum(lengths)
    following, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    following[ends - 1] = -1
    before[ends - lengths] = -1
    rank = np.full(n, NONE, np.int32)
    first = np.nonzero(following >= 0)[0]
    rank[first] = v.ranks(symbols[first], symbols[following[first]])
    alive = np.ones(n, bool)
    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def add(positions: np.ndarray) -> None:
        positions = positions[rank[positions] != NONE]
        if not len(positions):
            return
        own = rank[positions]
        by = np.argsort(own, kind="stable")
        positions, own = positions[by], own[by]
        cuts = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), len(own)]
        for a, b, r in zip(cuts, cuts[1:], own[cuts[:-1]].tolist(), strict=False):
            if r not in index:
                index[r] = []
                heapq.heappush(heap, r)
            index[r].append(positions[a:b])

    add(first)
    while heap:
        r = heapq.heappop(heap)
        parts = index.pop(r)
        at = np.sort(np.concatenate(parts))
        at = at[rank[at] == r]
        at = at[np.concatenate(([True], at[1:] != at[:-1]))] if len(at) > 1 else at
        if v.left[r] == v.right[r] and len(at) > 1:  # of overlapping positions every other one, from the left
            joined = np.concatenate(([False], following[at[:-1]] == at[1:]))
            run = np.maximum.accumulate(np.where(joined, 0, np.arange(len(at))))
            at = at[(np.arange(len(at)) - run) % 2 == 0]
        if not len(at):
            continue
        right = following[at]
        after = following[right]
        symbols[at], alive[right], rank[right] = v.made[r], False, NONE
        following[at] = after
        inner = after >= 0
        before[after[inner]] = at[inner]
        rank[at] = NONE
        rank[at[inner]] = v.ranks(symbols[at[inner]], symbols[after[inner]])
        prior = before[at]
        prior = prior[prior >= 0]
        rank[prior] = v.ranks(symbols[prior], symbols[following[prior]])
        add(np.concatenate((at, prior)))
    counts = np.add.reduceat(alive.astype(np.int64), ends - lengths) if len(pieces) else lengths
    return symbols[alive], counts


class Encoder:
    """Encodes texts, remembering pieces; between slices it forgets all of them once they are too many."""

    def __init__(self, path: str):
        self.v = vocabulary(path)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.starts, self.counts = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def chunks(self, text: str) -> list:
        """The text as parts that are encoded alone: a string stands for itself after a space, (s,) for s as it is."""
        if self.v.split and any(s in text for s in self.v.special):
            return [c for part in self.v.split.split(text) if part for c in ([(part,)] if part in self.v.special else self.plain(part))]
        return self.plain(text)

    @staticmethod
    def plain(text: str) -> list:
        parts: list = text.split(" ")
        if "" in parts or " \n" in text or "\n " in text or ODD_SPACE.search(text):
            parts = APART.split(text)
        parts[0] = (parts[0],)
        return parts if text else []

    def pieces(self, chunk) -> list[str]:
        if isinstance(chunk, str):
            if chunk.isalpha():
                return [" " + chunk]
            if chunk[:-1].isalpha() and chunk[-1] in ENDINGS:
                return [" " + chunk[:-1], chunk[-1]]
            return PIECE.findall(" " + chunk)
        return [chunk[0]] if chunk[0] in self.v.special else PIECE.findall(chunk[0])

    def learn(self, new: list) -> None:
        """Adds chunks to the table: their pieces are merged together."""
        cut = list(map(self.pieces, new))
        place = {p: i for i, p in enumerate(dict.fromkeys(chain.from_iterable(cut)))}
        plain = [p for p in place if p not in self.v.special]
        ids, counts = merge_all([p.encode("utf-8", "surrogatepass") for p in plain], self.v)
        if len(plain) < len(place):  # special tokens are pieces of one id; they follow the others
            rest = [p for p in place if p in self.v.special]
            place = {p: i for i, p in enumerate([*plain, *rest])}
            ids, counts = np.append(ids, [self.v.special[p] for p in rest]).astype(np.int32), np.append(counts, [1] * len(rest))
        starts = np.cumsum(counts) - counts
        used = np.fromiter(map(place.__getitem__, chain.from_iterable(cut)), np.int64)
        per_chunk = np.fromiter(map(len, cut), np.int64, len(cut))
        flat, totals = ragged(ids, starts[used], counts[used]), np.add.reduceat(counts[used], np.cumsum(per_chunk) - per_chunk)
        base = len(self.ids)
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        self.starts = np.concatenate((self.starts, base + np.cumsum(totals) - totals))
        self.counts = np.concatenate((self.counts, totals))
        self.ids = np.concatenate((self.ids, flat))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and their number in each text."""
        if len(self.known) > MOST_PIECES:
            self.forget()
        cut = list(map(self.chunks, texts))
        flat = list(chain.from_iterable(cut))
        used = np.fromiter(map(self.known.get, flat, repeat(-1)), np.int64, len(flat))
        if len(missing := np.flatnonzero(used < 0)):
            absent = [flat[i] for i in missing.tolist()]
            self.learn(list(dict.fromkeys(absent)))
            used[missing] = np.fromiter(map(self.known.__getitem__, absent), np.int64, len(absent))
        n = self.counts[used]
        per_text = np.fromiter(map(len, cut), np.int64, len(cut))
        bounds = np.concatenate(([0], np.cumsum(n)))[np.concatenate(([0], np.cumsum(per_text)))]
        return ragged(self.ids, self.starts[used], n), np.diff(bounds)


def ragged(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """values[starts[i] : starts[i] + counts[i]] for each i, one after another."""
    shift = starts - (np.cumsum(counts) - counts)
    return values[np.arange(counts.sum()) + np.repeat(shift, counts)]


def token_lists(ids: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(ids, pa.int32()))


def decode_lists(lists: pa.ListArray, v: Vocabulary) -> pa.Array:
    """The text of each list of ids; null lists decode to null."""
    flat = lists.flatten()
    spelled = pa.ListArray.from_arrays(lists.offsets.cast(pa.int32()) if lists.offset == 0 else pa.array(np.asarray(lists.offsets) - lists.offsets[0].as_py(), pa.int32()), v.arrow.take(flat))
    joined = pc.binary_join(spelled, pa.scalar(b"", pa.binary()))
    if lists.null_count:
        joined = pc.if_else(lists.is_valid(), joined, pa.scalar(None, pa.binary()))
    try:
        return joined.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([None if b is None else b.decode("utf-8", "replace") for b in joined.to_pylist()], pa.string())


def _over_rows(df: DataFrame, text_col: str, made: list[T.StructField], work) -> DataFrame:
    """df with columns made from one of its own, by work(list of its values) -> one or more tuples of Arrow arrays."""
    kept = [c for c in df.columns if c not in {f.name for f in made}]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        do = work()
        for b in batches:
            at = 0
            for arrays in do(b.column(text_col)):
                n = len(arrays[0])
                for k in range(0, n, ROWS):
                    m = min(ROWS, n - k)
                    yield pa.RecordBatch.from_arrays([b.column(c).slice(at + k, m) for c in kept] + [a.slice(k, m) for a in arrays], names=[*kept, *[f.name for f in made]])
                at += n
            release()

    return df.mapInArrow(run, T.StructType([*[df.schema[c] for c in kept], *made]))


def encode(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """df with ids_col, array<int> (in place of a column of that name)."""

    def work():
        encoder = Encoder(path)

        def do(texts: pa.Array):
            for part in text_slices(texts, SLICE_BYTES):
                yield (token_lists(*encoder.encode(part)),)

        return do

    return _over_rows(df, text_col, [T.StructField(ids_col, T.ArrayType(T.IntegerType()))], work)


def decode(df: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """df with text_col, the text of ids_col. Null ids give null."""

    def work():
        v = vocabulary(path)

        def do(lists: pa.Array):
            for k in range(0, len(lists), ROWS):
                yield (decode_lists(lists.slice(k, ROWS), v),)

        return do

    return _over_rows(df, ids_col, [T.StructField(text_col, T.StringType())], work)


def round_trip(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """encode and then decode of its ids, in one pass over Arrow batches."""

    def work():
        encoder, v = Encoder(path), vocabulary(path)

        def do(texts: pa.Array):
            for part in text_slices(texts, SLICE_BYTES):
                lists = token_lists(*encoder.encode(part))
                yield lists, decode_lists(lists, v)

        return do

    return _over_rows(df, text_col, [T.StructField(ids_col, T.ArrayType(T.IntegerType())), T.StructField(decoded_col, T.StringType())], work)


def digests(df: DataFrame, ids_col: str = "ids", decoded_col: str = "decoded") -> list:
    """n_tokens, ids_sha256 and decoded_sha256 of a round trip."""
    ids = F.array_join(F.col(ids_col).cast("array<string>"), ",")
    return [F.size(ids_col).cast("bigint").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2(decoded_col, 256).alias("decoded_sha256")]
