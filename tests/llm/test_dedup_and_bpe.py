import collections
import random
import re

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from dossier.llm import bpe, near_dup
from tests.llm.data import documents, empty

PATH = public_tokenizers.path("byte_bpe_50k.json")


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    bits = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), seed=42)
        for i in range(64):
            bits[i] += h >> i & 1
    return sum(1 << i for i in range(64) if 2 * bits[i] > len(shingles))


def slow_components(prints):
    """prints: (doc_id, fingerprint); the smallest id reachable over links of at most two bits."""
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    f = np.array([p for _, p in prints], np.uint64)
    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f ^ f[i]) <= 2):
            parent[find(int(j))] = find(i)
    least = {}
    for i, (d, _) in enumerate(prints):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return collections.Counter((d, least.get(find(i))) for i, (d, _) in enumerate(prints))


def test_fingerprints_and_components_match_brute_force(spark):
    rng = random.Random(4)
    base = [f"w{rng.randint(0, 400)}" for _ in range(300)]
    rows = []
    for i in range(120):
        words = list(base)
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = f"x{rng.randint(0, 50)}"
        rows.append((1000 + i, " ".join(words), "en", "a"))
    docs = documents(spark, [*rows, (2000, "One TWO", "en", "a"), (2001, "one two", "en", "a"), (2002, "é É", "fr", "a")])
    out = near_dup.near_duplicates(docs).collect()
    texts = docs.collect()
    assert collections.Counter((r.doc_id, r.fp & (2**64 - 1)) for r in out) == collections.Counter((r.doc_id, slow_fingerprint(r.text)) for r in texts)
    assert collections.Counter((r.doc_id, r.component_id) for r in out) == slow_components([(r.doc_id, slow_fingerprint(r.text)) for r in texts])


def test_crowded_buckets_lose_no_link(spark):
    """Thousands of fingerprints within a few bits of each other take the other way than pairs."""
    rng = random.Random(5)
    center = rng.getrandbits(64)
    prints = {center}
    while len(prints) < 1500:
        x = center
        for b in rng.sample(range(64), rng.randint(1, 4)):
            x ^= 1 << b
        prints.add(x)
    prints |= {rng.getrandbits(64) for _ in range(500)}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp bigint")
    roots = {r.node: r.component for r in near_dup.components(near_dup.links(df)).collect()}
    got = collections.Counter(roots.get(p, p) for p in signed)
    want = slow_components([(p, p & (2**64 - 1)) for p in signed])
    assert sorted(got.values()) == sorted(collections.Counter(c for _, c in want).values())


def test_one_document_of_each_group_stays(spark):
    docs = documents(spark)
    kept = near_dup.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 3, 6, 7, 8, 9] and ids.count(None) == 1
    assert near_dup.one_of_each(empty(spark)).count() == 0 and near_dup.near_duplicates(empty(spark)).count() == 0


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def random_texts(n):
    rng = random.Random(1)
    signs = [*"abcthe  \n\t'sdré1234ñ.,!<>| 　中文😀\x1c\x1f\x85", " the", "aaaa", "  ", "'ll", "<|endoftext|>", "\r\n", "I'm", "the.", ":"]
    return ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(n)] + ["", "a" * 5000, " " * 3000, "ab" * 3001, "<|endoftext|>", " <|endoftext|> x"]


def test_ids_equal_the_library(library):
    texts = random_texts(4000)
    e = bpe.Encoder(PATH)
    ids, n = e.encode(texts)
    at = np.concatenate(([0], np.cumsum(n)))
    for i, want in enumerate(library.encode_batch(texts, add_special_tokens=False)):
        assert ids[at[i] : at[i + 1]].tolist() == want.ids, texts[i]
    decoded = bpe.decode_lists(bpe.token_lists(ids, n), e.v).to_pylist()
    assert decoded == texts


def test_decoding_broken_bytes(library):
    v = bpe.vocabulary(PATH)
    lists = [[int(v.of_byte[0xC3])], [int(v.of_byte[0xE4]), int(v.of_byte[0xB8])], [], [50256, 262]]
    flat = np.array([i for x in lists for i in x], np.int32)
    got = bpe.decode_lists(bpe.token_lists(flat, np.array([len(x) for x in lists])), v).to_pylist()
    assert got == [library.decode(x, skip_special_tokens=False) for x in lists]


def test_round_trip_of_a_table(spark, library):
    docs = documents(spark)
    out = bpe.round_trip(docs, PATH)
    assert out.columns == [*docs.columns, "ids", "decoded"]
    for r in out.collect():
        assert r.ids == library.encode(r.text or "", add_special_tokens=False).ids and r.decoded == (r.text or "")
    apart = bpe.decode(bpe.encode(docs, PATH), PATH)
    assert [(r.doc_id, r.decoded) for r in apart.collect()] == [(r.doc_id, r.text or "") for r in docs.collect()]
    assert bpe.round_trip(empty(spark), PATH).count() == 0


def test_of_equal_ids_and_texts_the_least_row_stays(spark):
    """Rows that differ in other columns only: the same one stays however the table is partitioned; equal rows count once."""
    docs = documents(spark, [(50, "one two three four five", lang, source) for lang in ("en", "de", None) for source in ("a", "b")] * 2)
    kept = {n: sorted(map(repr, near_dup.one_of_each(docs.repartition(n)).collect())) for n in (1, 3, 5)}
    assert kept[1] == kept[3] == kept[5] and sum("doc_id=50" in r for r in kept[1]) == 1
