"""Stems, postings and ranks of full-text search against known stems and plain loops."""

import math
import random
import re

import pytest

from dossier.functions.stemming import STOP_WORDS, stem
from dossier.operators import fulltext, retrieval

STEMS = """consign consign consigned consign consigning consign consignment consign consisted consist consistency consist consistently consist
consolation consol consolatory consolatori consolidating consolid consolingly consol conspicuously conspicu conspiracy conspiraci conspirators conspir
constancy constanc knackeries knackeri knavish knavish kneaded knead knightly knight knitting knit knives knive knocker knocker
generate generat generally general hoping hope hopped hop flies fli ties tie dies die cries cri by by say say running run easily easili
relational relat national nation rationalization ration happiness happi hopefully hope agreement agreement vessels vessel engines engin
maintenance mainten replaced replac leaking leak skies sky dying die news news inning inning proceed proceed luxuriously luxuri gas gas this this kiwis kiwi
agreed agre feed feed university univers communication communic sensibilities sensibl analogies analog decisively decis""".split()


@pytest.mark.parametrize(("word", "want"), list(zip(STEMS[::2], STEMS[1::2], strict=True)))
def test_stems(word, want):
    assert stem(word) == want


def plain_rank(words, wanted):
    """By the formula, a pair of places after the other."""
    places = {x: [i for i, w in enumerate(words, 1) if w == x] for x in wanted}
    if not wanted or not all(places.values()):
        return None
    if len(wanted) == 1:
        return sum(0.1 / (k * k) for k in range(1, len(places[wanted[0]]) + 1)) / 1.64493406685
    left = 1.0
    for i, a in enumerate(wanted):
        for b in wanted[:i]:
            for x in places[a]:
                for y in places[b]:
                    left *= 1 - 0.1 * math.sqrt(1 / (1.005 + 0.05 * math.exp(min(abs(x - y) / 1.5 - 2, 80))))
    return 1 - left


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(8)
    words = "pump pumps pumping pumped seal sealed sealing the of leak leaking engines engine 42 éole and hull".split()
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 40)))) for i in range(60)]
    return [*rows, (60, None), (61, ""), (62, "Pump-Seal: the PUMPED; Seal."), (63, "filler " * 5000 + "pump far seal"), (64, "the of and")]


@pytest.mark.parametrize("english", [True, False])
def test_matches(spark, tmp_path, texts, english):
    path = str(tmp_path / "index")
    fulltext.build(spark.createDataFrame(texts, "id int, body string"), path, "id", "body", english)
    form = (lambda w: None if w in STOP_WORDS else stem(w)) if english else (lambda w: w)
    for query in ("pump seal", "Pumping!", "the sealed leaks", "engines of the hull pumps", "42 éole", "absent pump", "the of", ""):
        wanted = sorted({f for w in re.findall(r"[^\W_]+", query.lower()) if (f := form(w))})
        want = {i: r for i, t in texts if (r := plain_rank([form(w) for w in re.findall(r"[^\W_]+", (t or "").lower())], wanted)) is not None}
        got = {r.id: r["rank"] for r in fulltext.matches(spark, path, query, "id", english).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got), query


def test_only_a_querys_buckets_are_read(spark, tmp_path, texts):
    path = str(tmp_path / "index")
    fulltext.build(spark.createDataFrame(texts, "id int, body string"), path, "id", "body")
    found = fulltext.matches(spark, path, "pumping seals", "id")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*bucket", plan) and re.search(r"PushedFilters: \[[^]]*In\(lexeme", plan)
    assert len(found.inputFiles()) > 0
    folders = {r[0] for r in spark.read.parquet(path).select("bucket").distinct().collect()}
    assert len(folders) > 4


def test_ranks_in_a_hybrid_search(spark, tmp_path):
    path = str(tmp_path / "index")
    rows = [(1, 1, "a pump and its seals", [1.0, 0.0]), (2, 1, "sealing pumps", [1.0, 0.05]), (3, 1, "nothing here", [1.0, 0.01])]
    chunks = spark.createDataFrame(rows, "chunk_id int, document_id int, content string, embedding array<double>")
    fulltext.build(chunks, path, "chunk_id", "content")
    documents = spark.createDataFrame([(1, None)], "id int, root_id int")
    from pyspark.sql import functions as F

    ranks = fulltext.matches(spark, path, "pump seal", "chunk_id", within=chunks)
    hits = retrieval.match_chunks(chunks, documents, F.array(F.lit(1.0), F.lit(0.0)), 0.1, 3, ranks=ranks).collect()
    near = {r.chunk_id: r.similarity for r in hits}
    assert near[3] == pytest.approx(1 / math.hypot(1, 0.01))
    assert near[2] == pytest.approx(0.7 / math.hypot(1, 0.05) + 0.3 * plain_rank(["seal", "pump"], ["pump", "seal"]))
    assert near[1] == pytest.approx(0.7 + 0.3 * plain_rank(["", "pump", "", "", "seal"], ["pump", "seal"]))
