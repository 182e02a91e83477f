"""Operators on hand-written frames."""

import itertools
import random
import uuid

import pytest
from pyspark.sql import functions as F

from dossier.operators import diff, dml, entities, evals, ingest, quality, retrieval, topics, windows
from dossier.operators.components import components


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def frame(spark, schema, *data):
    return spark.createDataFrame(list(data), schema)


def test_changes_of_tables(spark):
    base = frame(spark, "k int, v string", (1, "a"), (2, "b"))
    assert rows(dml.upsert(base, frame(spark, "k int, v string", (2, "x"), (3, "y")), ["k"])) == [(1, "a"), (2, "x"), (3, "y")]
    assert rows(dml.insert_ignore(base, frame(spark, "k int, v string", (2, "x"), (3, "y"), (3, "y")), ["k"])) == [(1, "a"), (2, "b"), (3, "y")]
    assert rows(dml.coalesce_update(base, frame(spark, "k int, v string", (1, None), (2, "n")), ["k"], ["v"])) == [(1, "a"), (2, "n")]
    given = frame(spark, "k int, v struct<provided:boolean,value:string>", (1, (True, None)), (2, (False, "z")))
    assert rows(dml.partial_update(base, given, ["k"], ["v"])) == [(1, None), (2, "b")]
    chunks = frame(spark, "c int, ids array<string>", (1, ["a", "b"]), (2, ["c"]), (3, []), (4, None))
    out, n = dml.rewrite_ids(chunks, frame(spark, "old string, new string", ("a", "b")), "ids", "c")
    assert rows(out.select("c", "ids")) == [(1, ["b"]), (2, ["c"]), (3, []), (4, None)] and n.first().updated == 1
    log = frame(spark, "file string, status string, started_at timestamp, error string", ("a", "PROCESSING", None, None), ("b", "COMPLETED", None, None))
    assert [r.status for r in dml.reset_stale(log, F.current_timestamp(), 5).orderBy("file").collect()] == ["FAILED", "COMPLETED"]
    tagged = frame(spark, "entity_ids array<int>, entity_types array<string>, entity_classes array<string>", ([1], ["t"], ["c"]))
    none = F.array().cast("array<int>"), F.array().cast("array<string>"), F.array(F.lit("new"))
    assert rows(dml.retagged(tagged, *none)) == [(None, ["t"], ["new"])]


def test_windows(spark):
    e = frame(spark, "u int, at timestamp_ntz", *[(1, __import__("datetime").datetime(2024, 1, 1, 0, m)) for m in (0, 5, 40, 45, 59)])
    assert [r.session for r in windows.sessions(e, ["u"], "at", 30).orderBy("at").collect()] == [1, 1, 2, 2, 2]
    run = windows.last_run(e, ["u"], "at", 30).first()
    assert (run.rows, run.seconds) == (3, 19 * 60)
    seen = frame(spark, "q int, p int, t string", (1, 0, "b"), (1, 1, "a"), (1, 2, "b"))
    assert [r["index"] for r in windows.first_seen_index(seen, ["q"], "t", "p").orderBy("p").collect()] == [1, 2, 1]
    texts = frame(spark, "t array<string>", (["ab", "c", ""],), ([],))
    assert [r.x for r in texts.select(windows.running_offsets(F.col("t")).alias("x")).collect()] == [[0, 4, 7], []]


def test_diff(spark):
    a, b = frame(spark, "k int, v string", (1, "a"), (2, None), (3, "c")), frame(spark, "k int, v string", (2, None), (3, "x"), (4, "d"))
    assert rows(diff.status(a, b, ["k"], ["v"])) == [(1, "new"), (2, "unchanged"), (3, "changed"), (4, "stale")]
    assert diff.missing_columns(a, ["k", "w"]) == (["w"], ["v"])
    sets = frame(spark, "k int, x array<int>, y array<int>", (1, [1, 2], [2, 3]))
    assert rows(diff.set_changes(sets, "k", F.col("x"), F.col("y"))) == [(1, 1, -1), (1, 3, 1)]


def test_metrics(spark):
    hits = frame(spark, "question_id int, chunk_id string, rank int", (1, "x", 1), (1, "a", 2), (1, "b", 7), (2, "z", 1))
    relevant = frame(spark, "question_id int, chunk_id string", (1, "a"), (1, "b"), (2, "q"))
    one, two = evals.ranked_metrics(hits, relevant).orderBy("question_id").collect()
    import math

    assert (one.recall_at_5, one.recall_at_10, one.mrr) == (0.5, 1.0, 0.5) and two.mrr == two.ndcg_at_10 == 0
    assert one.ndcg_at_10 == pytest.approx((1 / math.log2(3) + 1 / math.log2(8)) / (1 + 1 / math.log2(3)))
    import statistics

    for values in ([3.0, 1.0], [float(i * i % 17) for i in range(10)], [float(i * 7 % 31) for i in range(25)]):
        got = evals.summary(frame(spark, "overall double", *[(v,) for v in values])).first()
        want = statistics.quantiles(values, n=10)[0] if len(values) >= 10 else min(values)
        assert (got.scored, got.p50, got.p10) == (len(values), round(statistics.median(values), 4), round(want, 4))


def test_citations(spark):
    good, other = "a" * 12, "b" * 12
    answers = frame(spark, "question_id int, found array<string>", (1, [good, good, "abc", other]), (2, []), (3, ["abc"]))
    known = frame(spark, "question_id int, chunk_id string", (1, good), (1, "abc"))
    checked = evals.validate_citations(answers, known, F.col("found"))
    assert rows(checked.select("question_id", "chunk_id", "valid"))[:3] == [(1, good, True), (1, "abc", False), (1, other, False)]
    assert rows(evals.citation_totals(answers, checked, F.col("found"))) == [(1, 4, 1, 2, False), (2, 0, 0, 0, False), (3, 1, 0, 1, True)]
    rules = lambda text, cited, quiet=False: spark.range(1).select(evals.format_violations(F.lit(text), F.lit(cited), F.lit(quiet), F.lit(False), ["Component:"])).first()[0]
    assert rules("Component: x", True) == [] and rules("plain", True) == ["missing Component header"] and rules("x" * 500, False) == ["no citations despite long response"] and rules("x" * 500, False, True) == []


def sequential_greedy(weights, pairs):
    """The plan as a loop: heaviest first, each free topic absorbs its free neighbours."""
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    gone, plan = set(), set()
    for t in sorted(weights, key=lambda t: (-weights[t], t)):
        if t in gone:
            continue
        for o in near.get(t, ()):
            if o not in gone and (-weights[o], o) > (-weights[t], t) and not any(k == o for _, k in plan):
                gone.add(o)
                plan.add((o, t))
    return plan


def test_merge_plans(spark):
    rng = random.Random(3)
    weights = {i: rng.randint(0, 5) for i in range(30)}
    pairs = [p for p in itertools.combinations(range(30), 2) if rng.random() < 0.08]
    t = frame(spark, "id int, chunk_count int, name string", *[(i, w, f"N-{i % 4}") for i, w in weights.items()])
    df = frame(spark, "a int, b int", *pairs)
    assert set(rows(topics.greedy_plan(t, df))) == sequential_greedy(weights, pairs)
    label = {r.node: r.component for r in components(df).collect()}
    for a, b in pairs:
        assert label[a] == label[b] <= min(a, b)
    plan = rows(topics.cluster_plan(t, df))
    for absorbed, keeper in plan:
        assert label[absorbed] == label[keeper] and (-weights[keeper], keeper) < (-weights[absorbed], absorbed)
    assert len(plan) == len(label) - len(set(label.values()))
    assert len(rows(topics.name_plan(t))) == 26


def test_topics_resolve(spark):
    known = frame(spark, "id string, name string, embedding array<float>", ("t1", "Main Engine", [1.0, 0.0]), ("t2", "Hull", [0.0, 1.0]))
    names = frame(spark, "name string, embedding array<float>", ("main-engine", [0.0, 1.0]), ("Shell", [0.1, 1.0]), ("Galley", [-1.0, -1.0]), ("galley!", [1.0, 1.0]))
    got = {r.name: (r.how, r.topic_id) for r in topics.resolve(names, known, 0.9).collect()}
    assert got["main-engine"] == ("name", "t1") and got["Shell"] == ("similar", "t2") and got["Galley"][0] == "new" and got["Galley"] == got["galley!"]


def test_entities(spark):
    register = frame(spark, "id int, name string, aliases array<string>, type string", (1, "Blue Whale", ["BW"], "x"), (2, "BW", [], "y"), (3, "Maran", ["blue whale"], "x"))
    terms = entities.lookup(register)
    assert rows(terms) == [("blue whale", 1), ("bw", 2), ("maran", 3)]
    docs = frame(spark, "d int, t string", (1, "The BLUE  whale and the amaranto"), (2, "maran, bw."), (3, None))
    found = entities.mentions(docs, terms, "d", "t")
    assert rows(found) == [(1, 1), (2, 2), (2, 3)]
    assert rows(entities.attributes(found, register, "d", ["type"])) == [(1, [1], ["x"]), (2, [2, 3], ["x", "y"])]
    near = entities.closest(frame(spark, "candidate string", ("blue whales",), ("zzz",)), terms)
    assert [(r.candidate, r.term) for r in near.collect()] == [("blue whales", "blue whale")]
    unknown = entities.unknown(frame(spark, "candidate string", ("MARAN",), ("MARAN EXTRA",), ("OTHER",)), terms)
    assert rows(unknown) == [("OTHER",)]


def test_retrieval_edges(spark):
    chunks = frame(spark, "chunk_id int, document_id int, content string, embedding array<float>, topic_ids array<int>", (1, 1, "pump seal", [1.0, 0.0], [1]), (2, 1, "x", [1.0, 0.0], []), (3, 2, "y", None, [1]), (4, 2, "z", [0.0, 0.0], [1]), (5, 9, "w", [1.0, 0.0], [1]))
    docs = frame(spark, "id int, root_id int, subject string", (1, 1, None), (2, 1, "two"), (7, None, "x"))
    q = F.array(F.lit(1.0), F.lit(0.0))
    out = retrieval.match_chunks(chunks, docs, q, 0.5, 10, text="pump", inherited=("subject",))
    assert [(r.chunk_id, round(r.similarity, 3)) for r in out.collect()] == [(2, 1.0), (1, 0.85)]
    assert retrieval.match_chunks(chunks, docs, q, 0.5, 10, topic_ids=[1]).count() == 1
    assert retrieval.match_chunks(chunks, docs, q, 0.5, 10, topic_ids=[]).count() == 0
    assert retrieval.fall_back(chunks.limit(0), chunks, 8).filter("not topic_filter_used").count() == 5


def test_checks(spark):
    docs = frame(spark, "id int, root_id int, depth int, document_type string", (1, 1, 0, "email"), (2, 1, 1, "pdf"), (3, 9, 1, "pdf"), (4, 1, 0, "email"))
    assert [r.key for r in quality.bad_roots(docs).orderBy("key").collect()] == ["3", "4"]
    assert [r.key for r in quality.root_not_email(docs).collect()] == ["3"]
    positions = frame(spark, "chunk_id int, char_start int, char_end int", (1, 0, 5), (2, 5, 5), (3, -1, -1), (4, None, 2), (5, -1, 0), (6, -2, 0))
    assert [r.key for r in quality.bad_positions(positions).orderBy("key").collect()] == ["2", "4"]
    links = frame(spark, "path string, text string", ("a.md", "[x](b.md) [y](http://u/z) [z](é.md) [w](missing/part)"))
    assert [r.detail for r in quality.broken_links(links, frame(spark, "path string", ("b.md",))).orderBy("detail").collect()] == ["non_ascii:é.md", "truncated:missing/part"]


def test_ingest(spark):
    tree = frame(spark, "id string, parent_id string", ("r", None), ("a", "r"), ("b", "a"))
    assert {(x.id, x.root_id, x.depth, tuple(x.path)) for x in ingest.with_hierarchy(tree).collect()} == {("r", "r", 0, ("r",)), ("a", "r", 1, ("r", "r")), ("b", "r", 2, ("r", "r", "a"))}
    text = "# Title\n\n" + "\n\n".join(f"Paragraph {i} has several words in its only sentence." for i in range(40))
    parts = ingest.split_text(text, 50, 10, lambda t: len(t.split()))
    assert all(len(p.split()) <= 60 for p in parts) and set(text.split()) == {w for p in parts for w in p.split()}
    docs = frame(spark, "doc_id int, text string", (1, text), (2, ""), (3, None))
    assert {r.doc_id for r in ingest.recursive_chunks(docs, size=50, overlap=10).collect()} == {1}
    windows_ = ingest.word_windows(docs, size=50, overlap=10).orderBy("chunk_index").collect()
    assert [w for w in windows_[0].content.split()][-10:] == windows_[1].content.split()[:10]
    made, filtered = ingest.message_chunks(frame(spark, "doc_id int, body string", (1, "word " * 30 + "\n-----Original Message-----\nok")))
    assert made.count() == 1 and filtered.first().reason == "too_short"


def test_summary_of_a_large_group_collects_no_array(spark):
    import statistics

    rng = random.Random(5)
    rows = [("hot", rng.choice([rng.gauss(0, 1) ** 3, 0.5])) for _ in range(5000)] + [(None, float(i)) for i in range(11)] + [("few", 2.0), ("few", 1.0), ("few", None), ("none", None)]
    out = evals.summary(spark.createDataFrame(rows, "kind string, overall double"), by=["kind"])
    assert not any(f in out._jdf.queryExecution().optimizedPlan().toString() for f in ("collect_list(overall", "percentile(overall"))
    got = {r.kind: (r.scored, r.p50, r.p10) for r in out.collect()}
    hot = sorted(v for k, v in rows if k == "hot")
    assert got["hot"] == (5000, round(statistics.median(hot), 4), round(statistics.quantiles(hot, n=10)[0], 4))
    assert got[None] == (11, 5.0, round(statistics.quantiles(map(float, range(11)), n=10)[0], 4)) and got["few"] == (2, 1.5, 1.0) and got["none"] == (0, None, None)


def test_greedy_plan_reads_pairs_once(spark, tmp_path):
    """Pairs may be a costly join: their plan runs once."""
    seen = str(tmp_path)

    def run(batches):
        for b in batches:
            with open(f"{seen}/{uuid.uuid4().hex}", "w") as f:
                f.write(str(b.num_rows))
            yield b

    pairs = [(a, b) for a in range(60) for b in range(a + 1, 60) if (a * b) % 7 == 1]
    t = frame(spark, "id int, chunk_count int", *[(i, i * 31 % 17) for i in range(60)])
    plan = rows(topics.greedy_plan(t, frame(spark, "a int, b int", *pairs).mapInArrow(run, "a int, b int")))
    assert set(plan) == sequential_greedy({i: i * 31 % 17 for i in range(60)}, pairs)
    assert sum(int(p.read_text()) for p in tmp_path.iterdir()) == len(pairs)


def test_greedy_plan_of_a_long_chain(spark):
    """A chain of 1,000 ever lighter topics: every second one is absorbed by the one before it, in a task or by rounds."""
    n = 1000
    t = frame(spark, "id int, chunk_count int", *[(i, n - i) for i in range(n)])
    chain = [(i, i + 1) for i in range(n - 1)]
    assert set(rows(topics.greedy_plan(t, frame(spark, "a int, b int", *chain)))) == {(i + 1, i) for i in range(0, n, 2)}
    rng = random.Random(8)
    weights = {i: rng.randint(0, 6) for i in range(40)}
    pairs = [p for p in itertools.combinations(range(40), 2) if rng.random() < 0.07]
    some = frame(spark, "id int, chunk_count int", *weights.items())
    for most in (0, 4):
        assert set(rows(topics.greedy_plan(some, frame(spark, "a int, b int", *pairs), most_edges=most))) == sequential_greedy(weights, pairs)


def test_names_of_many_words(spark):
    register = frame(spark, "id int, name string, aliases array<string>", (1, "Star of the North Sea Line", ["S.o.N."]), (2, "Star", []), (3, "sea-line", []))
    docs = frame(spark, "d int, t string", (1, "the star of  the north, sea line sails"), (2, "a start of the north sea line"), (3, "STAR of the north"), (4, "s o n and sea LINE"), (5, None), (6, ""))
    found = entities.mentions(docs, entities.lookup(register), "d", "t")
    assert sorted(rows(found)) == [(1, 1), (1, 2), (1, 3), (2, 3), (3, 2), (4, 1), (4, 3)]


def test_hierarchy_of_any_depth(spark):
    """A chain deeper than recursive queries go, a cycle and a lost parent."""
    chain = [(f"n{i:04d}", f"n{i - 1:04d}" if i else None) for i in range(300)]
    tree = frame(spark, "id string, parent_id string", *chain, ("x", "y"), ("y", "x"), ("z", "gone"))
    got = {r.id: (r.root_id, r.depth, r.path) for r in ingest.with_hierarchy(tree).collect()}
    assert got == {n: ("n0000", i, ["n0000", *(m for m, _ in chain[:i])]) for i, (n, _) in enumerate(chain)}


def test_index_recall(spark, tmp_path):
    import numpy as np

    from dossier.operators import index

    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    made = [(i, (centres[i % 12] + 0.4 * rng.normal(size=16)).tolist()) for i in range(3000)] + [(9000, None), (9001, [0.0] * 16)]
    index_rows, path = frame(spark, "chunk_id int, embedding array<double>", *made), str(tmp_path / "index")
    cell_rows, index.CELL_ROWS = index.CELL_ROWS, 100
    try:
        index.build(index_rows, path)
    finally:
        index.CELL_ROWS = cell_rows
    x = np.array([v for _, v in made[:3000]])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 3000, 600):
        exact = sorted(zip((-(u @ u[q])).round(12).tolist(), range(3000), strict=True))[:10]
        got = index.search(spark, path, x[q].tolist(), 10, probes=6)
        hits += len({r.chunk_id for r in got.collect()} & {i for _, i in exact})
        whole = index.search(spark, path, x[q].tolist(), 10, probes=1000).collect()
        assert {r.chunk_id for r in whole} == {i for _, i in exact}
    assert hits / 50 >= 0.9
    assert "PartitionFilters: [cell" in got._jdf.queryExecution().toString()  # the other cells are not read


def test_named_topics(spark):
    known = frame(spark, "id int, name string, embedding array<double>, chunk_count bigint", (1, "Hull", [1.0, 0.0], 0), (2, "Hull paint", [0.9, 0.3], 7), (3, "Galley", [0.0, 1.0], 5))
    names = lambda *n: frame(spark, "name string, embedding array<double>", *n)
    ask = lambda n, **k: retrieval.topic_names_filter(n, known, F.array(F.lit(1.0), F.lit(0.0)), **k).first()
    a = ask(names(("hull", [1.0, 0.0]), ("engine", [-1.0, -1.0])), threshold=0.99, looser=0.5)
    assert (a.decision, a.topic_ids, a.loosened, a.unmatched, a.chunks) == ("filter", [1, 2], True, ["engine"], 7)
    b = ask(names(("hull", [1.0, 0.0])), threshold=0.99, looser=0.98)
    assert (b.decision, b.topic_ids, b.suggested[0]) == ("skip_no_chunk", [1], "Hull paint")
    c = ask(names(("engine", [-1.0, -1.0])))
    assert (c.decision, c.topic_ids, c.unmatched) == ("skip_no_topic", [], ["engine"])
    d = retrieval.topic_names_filter(known.select("name", "embedding").limit(0), known, F.array(F.lit(1.0), F.lit(0.0))).first()
    assert (d.decision, d.chunks) == ("broad", 0)
