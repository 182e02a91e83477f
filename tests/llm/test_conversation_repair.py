"""Conversation repair against an exhaustive search over edits."""

import hashlib
import random
import re
import sys
import zlib

import pytest

from dossier.llm import conversation_repair as cr
from dossier.llm import queries

SCHEMA = "conv_id bigint, turn bigint, role string, text string, audit string, cost int, place int, conv string"
WHITE = " \t\n\x0b\x0c\r"


def cheapest(turns):
    """(cost, audit, repaired): turns are (role, text, must go, cut off); by all edits, from the last turn on."""
    roles = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    names = {"u": "user", "a": "assistant"}
    seen = {}

    def best(i, q, inserts=0):
        if (i, q, inserts) in seen:
            return seen[i, q, inserts]
        options = []
        if i == len(turns) and q in (0, 3):
            options.append((0, "", ()))
        if inserts < 4:
            for x, name in names.items():
                if x in roles[q]:
                    c, a, r = best(i, roles[q][x], inserts + 1)
                    options.append((c + 5, "I" + a, ((name, ""), *r)))
        if i < len(turns):
            role, text, gone, cut = turns[i]
            c, a, r = best(i + 1, q)
            options.append((c + 2, "D" + a, r))
            if not gone:
                if role[:1] in roles[q]:
                    c, a, r = best(i + 1, roles[q][role[:1]])
                    options.append((c + 5 * cut, "K" + a, ((role, text), *r)))
                for x, name in names.items():
                    if x in roles[q]:
                        c, a, r = best(i + 1, roles[q][x])
                        options.append((c + 5 * cut + 1, "R" + a, ((name, text), *r)))
        seen[i, q, inserts] = min(options, key=lambda o: o[:2], default=(10**9, "", ()))
        return seen[i, q, inserts]

    return best(0, 0)


def code(role, gone, cut, fault=0):
    return ("sua".find(role[:1]) if role[:1] in tuple("sua") else 3) + cr.MUST_GO * gone + cr.CUT * cut + cr.FAULT * fault


@pytest.mark.parametrize("seed", range(4))
def test_layers_equal_all_edits(seed):
    rng = random.Random(seed)
    for _ in range(400):
        turns = [(rng.choice(("user", "assistant", "user", "assistant", "system", "tool", "")), f"t{i}", rng.random() < 0.2, rng.random() < 0.2) for i in range(rng.randrange(9))]
        cost, audit, repaired = cheapest(turns)
        assert cr.repair(bytes(code(r, g, c) for r, _, g, c in turns)) == (cost, audit)
        assert tuple(cr.rewritten(audit, iter([t[:2] for t in turns]))) == repaired


def brute(rows):
    out, by = [], {}
    for r in rows:
        by.setdefault(r.conv_id, [])
        told = [" " if v is None else str(v) for v in (r.conv_id, r.turn, r.role, r.text)]
        kind = zlib.crc32(f"{told[0]}:{told[1]}".encode()) % 20
        role, text = ("user" if kind == 4 else told[2]), {1: "", 2: re.sub("[.!?]", "", told[3])}.get(kind, told[3])
        by[r.conv_id] += [(r.turn is not None, r.turn or 0, role, hashlib.sha256(text.encode()).digest(), text)] * {0: 0, 3: 2}.get(kind, 1)
    for conv, held in by.items():
        turns, seen, n = [], set(), dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, _, role, _, text in sorted(held):
            blank, again, cut = not text.strip(WHITE), (role, text) in seen, text.strip(WHITE)[-1:] not in tuple(".!?")
            seen.add((role, text))
            if fault := "blank" if blank else "duplicate" if again else "truncated" if cut else None:
                n[fault] += 1
            turns.append((role, text, blank or again, cut))
        times = {t for known, t, *_ in held if known}
        gaps = max(times) - min(times) + 1 - len(times) if times else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
        cost, audit, repaired = cheapest(turns)
        out.append((conv, gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()))
    return sorted(out, key=repr)


def run(spark, tmp_path, rows):
    df = spark.createDataFrame([(*r, "x", 1, 2, "y") for r in rows], SCHEMA)
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op11_conversation_repair(spark, str(tmp_path))
    types = [("conv_id", "bigint"), *[(c, "bigint") for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", "string"), ("repaired_sha256", "string")]
    assert got.dtypes == types
    return sorted(map(tuple, got.collect()), key=repr), brute(df.collect())


def test_contract(spark, tmp_path):
    """Nulls in every column, ties, repeated rows, odd roles and white space, a long text, conversations that lose all."""
    rng = random.Random(5)
    texts = ["Fine.", "Yes!", "cut off", "", " \x0b\n ", None, "ends. \n", "x " * 50_000 + "?", "a\xa0"]
    roles = ["user", "assistant", "system", "user", "assistant", None, "", "Tool"]
    rows = [(c if c < 38 else None, rng.choice((t, t, t, 3, None)), rng.choice(roles), rng.choice(texts)) for c in range(40) for t in range(rng.randrange(1, 9))]
    lost = next(c for c in range(100, 1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got, want = run(spark, tmp_path, [*rows, (lost, 0, "user", "Gone.")])
    assert got == want and (lost, *[0] * 6, "", hashlib.sha256(b"").hexdigest()) in got


def test_one_conversation_holds_most_rows(spark, tmp_path, monkeypatch):
    """A conversation over many tasks: its turns come in stretches that are put together in order."""
    monkeypatch.setattr(cr, "_turn_bytes", lambda keyed, of=cr._turn_bytes: parts.append(of(keyed)) or parts[-1])
    sys.setrecursionlimit(10_000)  # of the brute force
    rng = random.Random(6)
    rows = [(7, t, rng.choice(("user", "assistant")), f"Turn {t % 90}" + rng.choice((".", ".", "!", ""))) for t in range(250)] + [(1, 0, "user", "Hi."), (1, 1, "assistant", "Hi.")]
    parts = []
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got, want = run(spark, tmp_path, rows)
        assert parts[0].filter("conv = '=7'").count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == want


def test_empty_table(spark, tmp_path):
    assert run(spark, tmp_path, []) == ([], [])


def test_repaired_turns(spark):
    rows = spark.createDataFrame([(1, 0, "assistant", "Hello."), (1, 1, "user", "Who?"), (1, 2, "assistant", "Me."), (None, 0, "user", "Alone.")], "conv_id int, turn int, role string, text string")
    got = [tuple(r) for r in cr.repaired(rows).orderBy("conv_id", "place").collect()]
    assert got == [("1", 0, "user", "Who?"), ("1", 1, "assistant", "Me.")]
