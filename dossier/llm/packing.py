"""Packing documents into training sequences by power-of-two decomposition.

A document's ids are cut into pieces of `longest` ids and, for the rest, one piece for each bit of its length, longest first. A piece is a
sequence of its own: its length is a power of two, so nothing is padded and no sequence crosses documents. Sequences of
one length form a bucket; they are numbered bucket by bucket, the longest first, by document and start within it, so a batch of
equal lengths is a range of numbers.

Ids are those of the tokenizers library. Words between white space never share an id, nor do the parts of a word of ASCII and Latin
letters, so texts are cut into these by classes of their bytes, all of a slice at once, and each worker remembers the ids of parts it met, in
a table of bounded size whose keys are the bytes themselves. New parts are merged together, in rounds; words that hold any other
character go to the library whole.

Defined cases: a null text is an empty one and has the end id alone; texts are packed whole, whatever their length; rows that
repeat an id are packed each for themselves, equal ones interchangeably; an empty table gives an empty result; further columns are
kept, but those named as a column made here are replaced by it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cached_property, lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossier.llm.bpe import NONE, Vocabulary, byte_symbols, ragged
from dossier.llm.ranks import ranked
from dossier.llm.slices import release, text_slices

LONGEST = 2048
END_ID = 1
SLICE_BYTES = 1_000_000  # of texts cut into parts at a time
TABLE_CHARS = 2_500_000  # of parts remembered by a worker
FIRST_BITS = 16  # of the table of parts; it grows
BLOCK = 100_000  # parts looked up at a time
ODD_WORDS = 5_000  # given to the library at a time
PIECES = 500  # in an output batch: 4 MB of ids

#: Classes of bytes. A word that holds an odd byte, or a mark of a special token, is odd as a whole.
BLANK, LETTER, DIGIT, MARK, ODD = range(5)


def byte_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Class and lower case of each byte and of each pair of bytes that stands for a character from U+00C0 to U+017F.

    Pairs count for Latin letters that no normalization changes and that lower-case one to one, and the signs among them.
    """
    of, lower = np.full(256, ODD, np.uint8), np.arange(256, dtype=np.uint8)
    of[[*b" \t\n\x0b\x0c\r"]] = BLANK
    for b in range(ord("!"), ord("~") + 1):
        of[b] = LETTER if chr(b).isalpha() else DIGIT if chr(b).isdigit() else MARK
        lower[b] = ord(chr(b).lower())
    pair_of, pair_lower = np.full(192, ODD, np.uint8), np.zeros((2, 192), np.uint8)
    for k in set(range(191)) - {0x130 - 0xC0}:
        c = chr(0xC0 + k)
        pair_of[k], pair_lower[:, k] = LETTER if c.isalpha() else MARK, list(c.lower().encode())
    return of, lower, pair_of, pair_lower


CLASS, LOWER, PAIR_CLASS, PAIR_LOWER = byte_tables()
KEY_BYTES = 23  # of a part that has a slot of the table; longer ones are in a dictionary
#: Which bits of 8 bytes, of the next 8 and of the next 7 belong to a part of some length.
KEY_MASKS = np.array([[(1 << 8 * min(max(n - at, 0), most)) - 1 for n in range(KEY_BYTES + 1)] for at, most in ((0, 8), (8, 8), (16, 7))], np.uint64)
ROOM = np.zeros(24, np.uint8)  # after the last byte

MADE = T.StructType(
    [
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids", T.BinaryType()),
        T.StructField("doc_tokens", T.LongType()),
    ]
)


class Merges(Vocabulary):
    """The vocabulary's merges, applied to many short pieces at once."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        ids, mark = model["vocab"], model["end_of_word_suffix"]
        self.inner, self.final = np.zeros(256, np.int64), np.zeros(256, np.int64)
        for c, b in byte_symbols().items():
            self.inner[b], self.final[b] = ids[c], ids[c + mark]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.size = max(ids.values()) + 1
        self.left, self.right = (np.array([ids[m[k]] for m in merges], np.int64) for k in (0, 1))
        self.made = np.array([ids[a + b] for a, b in merges], np.int64)
        self.hash_pairs(self.left * self.size + self.right)

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, one after another, and their number in each.

        In each round every piece merges its pair of least rank, wherever it occurs; pieces without one leave.
        """
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        symbols, piece = self.inner[raw], np.repeat(np.arange(len(pieces)), lengths)
        symbols[np.cumsum(lengths) - 1] = self.final[raw[np.cumsum(lengths) - 1]]
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            rank = np.full(len(symbols), NONE, np.int32)
            inner = np.flatnonzero(piece[1:] == piece[:-1])
            rank[inner] = self.ranks(symbols[inner], symbols[inner + 1])
            first = np.flatnonzero(np.concatenate(([True], piece[1:] != piece[:-1])))
            best = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(piece))))
            if (whole := best == NONE).any():
                done.append((piece[whole], symbols[whole]))
                symbols, piece, rank, best = symbols[~whole], piece[~whole], rank[~whole], best[~whole]
                if not len(symbols):
                    break
            at = np.flatnonzero(rank == best)
            if len(at) > 1:  # of overlapping pairs every other one, from the left
                joined = np.concatenate(([False], at[1:] == at[:-1] + 1))
                run = np.maximum.accumulate(np.where(joined, 0, np.arange(len(at))))
                at = at[(np.arange(len(at)) - run) % 2 == 0]
            symbols[at] = self.made[rank[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            symbols, piece = symbols[keep], piece[keep]
        of, ids = (np.concatenate(x) for x in zip(*done, strict=True)) if done else (np.zeros(0, np.int64),) * 2
        order = np.argsort(of, kind="stable")
        return ids[order].astype(np.uint32), np.bincount(of, minlength=len(pieces)).astype(np.int64)


@lru_cache(maxsize=2)
def merges(path: str) -> Merges:
    return Merges(path)


class Parts:
    """The parts of texts that are encoded each for itself, as ranges of bytes in lower case.

    A part is a run of letters, a digit, a run of marks or the ending of a contraction, as the vocabulary's pre-tokenizer has them:
    `'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+`. An odd word is one part, in its own case.
    """

    def __init__(self, texts: list[str]):
        encoded = [t.encode() for t in texts]
        joined = b" ".join([*encoded, b""])
        raw = np.concatenate((np.frombuffer(joined, np.uint8), ROOM))
        data, kind = LOWER[raw], CLASS[raw]
        kind[len(joined) :] = BLANK
        lead = np.flatnonzero((raw >= 0xC3) & (raw <= 0xC5))
        if len(lead):
            pair = (raw[lead] - 0xC3).astype(np.int64) * 64 + (raw[lead + 1] & 63)
            kind[lead] = kind[lead + 1] = PAIR_CLASS[pair]
            plain = PAIR_CLASS[pair] != ODD
            data[lead[plain]], data[lead[plain] + 1] = PAIR_LOWER[:, pair[plain]]
        if b"<|" in joined:
            kind[:-1][(raw[:-1] == ord("<")) & (raw[1:] == ord("|"))] = ODD
        odd = np.flatnonzero(kind == ODD)
        if len(odd):
            blank = kind == BLANK
            word = np.cumsum(blank, dtype=np.int32)
            hit = np.zeros(int(word[-1]) + 1, bool)
            hit[word[odd]] = True
            whole = hit[word] & ~blank
            kind[whole], data[whole] = ODD, raw[whole]
        full = kind != BLANK
        begins = full & (kind == DIGIT)
        begins[0] |= full[0]
        begins[1:] |= full[1:] & (kind[1:] != kind[:-1])
        at = np.flatnonzero(data == ord("'"))
        if len(at):
            at = at[begins[at] & (kind[at] == MARK)]
            one, two = data[at + 1], data[at + 2]
            short = np.isin(one, [*b"stmd"])
            long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
            begins[at[short | long] + 1] = False
            after = np.concatenate((at[short] + 2, at[long] + 3))
            begins[after] = full[after]
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(full[:-1] & (begins[1:] | ~full[1:])) + 1
        self.data, self.odd = data, kind[self.starts] == ODD
        stops = np.cumsum(np.fromiter(map(len, encoded), np.int64, len(encoded)) + 1)
        self.per_text = np.diff(np.searchsorted(self.starts, stops), prepend=0)

    def keys(self, a: int, b: int) -> np.ndarray:
        """Three numbers that hold the bytes and the length of each part; the length alone says that it is too long."""
        at, n = self.starts[a:b], self.ends[a:b] - self.starts[a:b]
        eight = np.ndarray(len(self.data) - 7, "<u8", self.data, strides=(1,))
        short = np.minimum(n, KEY_BYTES)
        first, second, third = (eight[at + 8 * k] & KEY_MASKS[k][short] for k in range(3))
        return np.stack((first, second, third | short.astype(np.uint64) << np.uint64(56)))


class Words:
    """Ids of texts by the ids of their parts: common ones by the merges, odd words by the library itself."""

    def __init__(self, path: str):
        self.path, self.merges = path, merges(path)
        self.forget()

    @cached_property
    def tokenizer(self):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(self.path)
        t.no_padding()
        t.no_truncation()
        return t

    def forget(self) -> None:
        self.long: dict[bytes, int] = {}
        self.bits, self.chars, self.ids = FIRST_BITS, 0, np.zeros(0, np.uint32)
        self.starts, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.slots, self.filled = np.zeros((1 << self.bits, 4), np.uint64), 0

    def slot(self, keys: np.ndarray) -> np.ndarray:
        h = keys[0] * np.uint64(0x9E3779B97F4A7C15)
        for k in keys[1:]:
            h = ((h ^ h >> np.uint64(32)) + k) * np.uint64(0xD6E8FEB86659FD93)
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each part, -1 for those not in the table."""
        out, rest, slot = np.full(keys.shape[1], -1, np.int64), None, self.slot(keys)
        while len(slot):
            held = self.slots.take(slot, axis=0)
            same = (held[:, 0] == keys[0]) & (held[:, 1] == keys[1]) & (held[:, 2] == keys[2])
            on = np.flatnonzero(~same & (held[:, 2] != 0))
            hit = np.flatnonzero(same)
            out[hit if rest is None else rest[hit]] = held[hit, 3]
            rest = on if rest is None else rest[on]
            slot, keys = (slot[on] + 1) & (len(self.slots) - 1), keys[:, on]
        return out

    def insert(self, rows: np.ndarray) -> None:
        """Rows of a key and a number go into the table, each at the first free slot from its own; it stays at least half empty."""
        self.filled += len(rows)
        if 2 * self.filled > len(self.slots):
            rows = np.concatenate((self.slots[self.slots[:, 2] != 0], rows))
            self.bits = (2 * self.filled - 1).bit_length()
            self.slots = np.zeros((1 << self.bits, 4), np.uint64)
        slot = self.slot(rows.T[:3])
        while len(rows):
            free = np.flatnonzero(self.slots[slot, 2] == 0)
            self.slots[slot[free]] = rows[free]
            on = np.flatnonzero(self.slots[slot, 3] != rows[:, 3])
            rows, slot = rows[on], (slot[on] + 1) & (len(self.slots) - 1)

    def learn(self, new: list[bytes], odd: np.ndarray) -> int:
        """Ids of further parts, those marked as odd after the others; returns the number of the first."""
        at = int(len(self.counts))
        plain = new[: len(new) - int(odd.sum())]
        ids, counts = self.merges.encode(plain)
        found, sizes = [ids], [counts]
        words = [w.decode() for w in new[len(plain) :]]
        for k in range(0, len(words), ODD_WORDS):
            got = [e.ids for e in self.tokenizer.encode_batch(words[k : k + ODD_WORDS], add_special_tokens=False)]
            found.append(np.fromiter(chain.from_iterable(got), np.uint32))
            sizes.append(np.fromiter(map(len, got), np.int64, len(got)))
        counts = np.concatenate(sizes)
        self.starts = np.concatenate((self.starts, len(self.ids) + np.cumsum(counts) - counts))
        self.counts, self.ids = np.concatenate((self.counts, counts)), np.concatenate((self.ids, *found))
        self.chars += sum(map(len, chain(plain, words)))
        return at

    def numbers(self, parts: Parts, a: int, b: int) -> np.ndarray:
        """The number of each part from a to b; new ones are learnt."""
        keys = parts.keys(a, b)
        starts, ends, odd = parts.starts[a:b], parts.ends[a:b], parts.odd[a:b]
        short = ends - starts <= KEY_BYTES
        out = self.find(keys)
        ranges = lambda at: [parts.data[i:j].tobytes() for i, j in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
        if len(at := np.flatnonzero(~short)):
            out[at] = np.fromiter(map(self.long.get, ranges(at), repeat(-1)), np.int64, len(at))
        if len(missing := np.flatnonzero(out < 0)):
            missing = missing[np.argsort(odd[missing], kind="stable")]
            words = ranges(missing)
            place = {w: i for i, w in enumerate(dict.fromkeys(words))}
            of = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
            first = np.zeros(len(place), np.int64)
            first[of] = missing
            new = list(place)
            number = self.learn(new, odd[first]) + np.arange(len(new))
            out[missing] = number[of]
            own = np.flatnonzero(short[first])
            self.insert(np.column_stack((*keys[:, first[own]], number[own].astype(np.uint64))))
            self.long.update((new[i], int(number[i])) for i in np.flatnonzero(~short[first]).tolist())
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and their number in each text."""
        if self.chars > TABLE_CHARS:
            self.forget()
        parts = Parts(texts)
        used = np.concatenate([np.zeros(0, np.int64), *(self.numbers(parts, k, min(k + BLOCK, len(parts.starts))) for k in range(0, len(parts.starts), BLOCK))])
        n = self.counts[used]
        bounds = np.concatenate(([0], np.cumsum(n)))[np.concatenate(([0], np.cumsum(parts.per_text)))]
        return ragged(self.ids, self.starts[used], n), np.diff(bounds)


@lru_cache(maxsize=1)
def words_of(path: str) -> Words:
    """A worker's table, kept from task to task."""
    return Words(path)


def cuts(n: np.ndarray, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pieces of documents of n ids: as many of `longest` (a power of two) as there are, then the bits of the rest.

    Of each piece its document's place in n, its start there and its length.
    """
    whole, powers = n // longest, np.arange(longest.bit_length() - 1)[::-1]
    bits = (n % longest)[:, None] >> powers & 1
    per_document = whole + bits.sum(1)
    of = np.repeat(np.arange(len(n)), per_document)
    place = np.arange(len(of)) - np.repeat(np.cumsum(per_document) - per_document, per_document)
    sizes = np.full(len(of), longest, np.int64)
    sizes[place >= whole[of]] = 1 << powers[np.nonzero(bits)[1]]
    return of, np.cumsum(sizes) - sizes - (np.cumsum(n) - n)[of], sizes


def lengths(n: int, longest: int = LONGEST) -> list[int]:
    """The lengths of the pieces of n ids."""
    return cuts(np.array([n]), longest)[2].tolist()


def pieces(docs: DataFrame, path: str, text_col: str = "text", longest: int = LONGEST, end_id: int = END_ID) -> DataFrame:
    """A row for each piece of each document: its columns but the text, with start, length, ids and doc_tokens.

    ids holds the piece's ids as little-endian unsigned 32-bit integers; doc_tokens counts the document's ids with the end id.
    """
    kept = [c for c in docs.columns if c != text_col and c not in MADE.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of(path)
        for b in batches:
            others = b.select(kept) if kept else None
            at = 0
            for texts in text_slices(b.column(text_col), SLICE_BYTES):
                ids, counts = words.encode(texts)
                own = np.insert(ids, np.cumsum(counts), end_id).astype("<u4", copy=False)
                of, starts, sizes = cuts(counts + 1, longest)
                bounds = np.concatenate(([0], np.cumsum(sizes)))
                for k in range(0, len(of), PIECES):
                    part, edges = slice(k, k + PIECES), bounds[k : k + PIECES + 1]
                    offsets = pa.py_buffer((4 * (edges - edges[0])).astype(np.int32))
                    held = pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, offsets, pa.py_buffer(own[edges[0] : edges[-1]])])
                    carried = others.take(pa.array(at + of[part])).columns if others is not None else []
                    columns = [pa.array(starts[part]), pa.array(sizes[part]), held, pa.array(counts[of[part]] + 1)]
                    yield pa.RecordBatch.from_arrays([*carried, *columns], names=[*kept, *MADE.names])
                at += len(texts)
            release()

    return docs.select(*[F.col(f"`{c}`") for c in kept], text_col).mapInArrow(run, T.StructType([*[docs.schema[c] for c in kept], *MADE.fields]))


def numbered(packed: DataFrame, order: list[str]) -> DataFrame:
    """A written table of pieces with sequence_id, numbered by bucket, longest first, and by order within it, and offset."""
    buckets = packed.groupBy("length").agg(F.count(F.lit(1)).alias("_n"))  # as many rows as there are powers of two
    longer = Window.partitionBy(F.lit(0)).orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.select("length", F.coalesce(F.sum("_n").over(longer), F.lit(0)).alias("_base"))
    placed = ranked(packed, ["length"], order, "_rank", "_size").join(buckets, "length")
    return placed.withColumn("sequence_id", F.col("_base") + F.col("_rank")).withColumn("offset", F.lit(0).cast("bigint")).drop("_base", "_rank", "_size")
