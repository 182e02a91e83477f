import collections
import hashlib
import math
import random
import re

from dossier.llm import mixing, pii, quality_rules
from dossier.llm.common import prefix_sums, running
from tests.llm.data import documents, empty

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_running_totals_over_blocks(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(list(range(n)),) for n in (0, 1, 5, 128, 129, 700)], "a array<bigint>")
    for r in df.select("a", prefix_sums(F.col("a")).alias("s"), running(F.col("a"), lambda x, y: F.greatest(x, y)).alias("m")).collect():
        sums = [0]
        for x in r.a:
            sums.append(sums[-1] + x)
        assert r.s == sums
        assert r.m == [0, *[max(r.a[: i + 1]) for i in range(len(r.a))]]


def counts(text):
    words = WORD.findall(text or "")
    grams = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {k for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for k in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_counts_match_brute_force(spark):
    more = [(20, "a b c d e f a b c d e", "en", "a"), (21, "x\nx\ny # $\n\nx", "en", "a"), (22, "q " * 50, "en", "a"), (23, "é😀 ñ & |", "es", "b")]
    docs = documents(spark, more)
    out = quality_rules.judge(docs)
    want = sorted((str(r.doc_id), *counts(r.text)) for r in docs.collect())
    got = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in out.collect())
    assert got == want
    for r in out.collect():
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.kept and r.base_failed)


def test_quality_adapts_to_the_group(spark):
    plain = " ".join(f"word{i}" for i in range(40))
    noisy = " ".join(f"word{i}###" for i in range(40))
    rows = [(100 + i, f"{plain} {i}", "en", "clean") for i in range(150)] + [(400 + i, f"{noisy} {i}", "en", "noisy") for i in range(150)]
    kept = {r.doc_id: r.kept for r in quality_rules.judge(documents(spark, [*rows, (900, noisy, "en", "clean")])).collect()}
    assert all(kept[i] for i in range(100, 250)) and all(kept[i] for i in range(400, 550))
    assert not kept[900]


def test_quality_of_an_empty_table(spark):
    assert quality_rules.judge(empty(spark)).count() == 0


PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(digits):
    total = sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits))))
    return total % 10 == 0


def base_spans(text):
    out = []
    for no, (kind, pattern) in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if (kind == "ip" and any(int(p) > 255 for p in m[0].split("."))) or (kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits))) or (kind == "phone" and not 9 <= len(digits) <= 15):
                continue
            out.append((m.start(), no, m.end(), kind))
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(out)]


TEXTS = [
    "mail é a.b@c.de, a@b.c_d@e.f and x@y", "ip 1.2.3.4 1.2.3.4.5.6.7.8 300.1.1.1 001.02.3.0255 1.2.3", "card 4337 1665 9846 4399 and 4337166598464399, 4337166598464390", "call +1 (988) 555-2485 or +12 345 or ++1 988 555 2485-",
    "😀 4337-1665-9846-4399 😀 +49 30 1234567890", "IBAN DE89 3704 0044 0532 0130 00 and DE88370400440532013000", "ssn 123-45-6789", "order 123-45-6789", "phone (988) 555-2485, page (988) 555-2485 " + "x" * 60 + " (988) 555-2485",
    "9" * 3000, "a.b" * 2000 + "@", "1." * 3000, "+" * 500, "- " * 500 + "5",
]


def test_pii_spans_match_brute_force(spark):
    docs = documents(spark, [(100 + i, t, "en", "a") for i, t in enumerate(TEXTS)])
    found = pii.detect(docs)
    for r in found.collect():
        base = [f"{s.kind}:{s.start}:{s.end}" for s in r.spans if s.kind_no < len(pii.BASE)]
        assert base == base_spans(r.row.text), r.row.text
        assert [(s.start, s.kind_no) for s in r.spans] == sorted((s.start, s.kind_no) for s in r.spans)
    more = {r.row.doc_id: [s.kind for s in r.spans if s.kind_no >= len(pii.BASE)] for r in found.collect()}
    assert more[105] == ["iban"] and more[106] == ["ssn"] and more[107] == []
    assert more[108] == ["local_phone", "local_phone"]


def test_pii_redaction_keeps_rows_and_columns(spark):
    docs = documents(spark, [(100, "a 1.2.3.4 b x@y.zz c +1 (988) 555-2485 d 4337166598464399", "en", "a"), (101, "4337166598464399@1.2.3.4 z", "en", "a")])
    out = pii.redacted(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    by_id = {r.doc_id: r.text for r in out.collect()}
    assert by_id[100] == "a [IP] b [EMAIL] c [PHONE] d [CARD]"
    assert by_id[101] == "[EMAIL] z"
    assert by_id[3] is None and by_id[4] == ""
    assert pii.redacted(empty(spark)).count() == 0


def test_pii_checksums():
    assert luhn("4337166598464399") and hashlib.sha256(b"").hexdigest().startswith("e3b0")


def expected_targets(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    total, capped = share * sum(sizes.values()), set()
    while True:
        left = total - sum(cap * sizes[s] for s in capped)
        open_weight = sum(w[s] for s in sizes if s not in capped)
        out = {s: cap * sizes[s] if s in capped else left * w[s] / open_weight for s in sizes}
        over = {s for s in sizes if s not in capped and out[s] > cap * sizes[s]}
        if not over:
            return out
        capped |= over


def test_mixing_meets_its_targets(spark):
    rows = [(1000 + i, " ".join(["w"] * (1 + i * i % 97)), "en", ["a", "b", "c", "é", None][i % 5] if i > 300 else "a") for i in range(1500)]
    docs = documents(spark, rows)
    out = mixing.mix(docs).collect()
    assert len(out) == docs.count()
    sizes = collections.Counter()
    for r in docs.collect():
        sizes[r.source] += len(WORD.findall(r.text or ""))
    want = expected_targets(sizes)
    taken = collections.Counter()
    for r in out:
        taken[r.source] += r.taken
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
    largest = max(r.size for r in out)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest, (s, taken[s], want[s])
    again = mixing.mix(docs).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, out))


def test_mixing_is_an_exponential_tilt(spark):
    import math

    rows = [(i, " ".join(["w"] * (5 + i % 40)), "en", "ab"[i % 2]) for i in range(400)]
    out = mixing.mix(documents(spark).limit(0).unionByName(documents(spark, rows).filter("doc_id is not null"))).filter("source = 'b'").collect()
    # the log odds of a rate are linear in the size
    free = [(r.size, math.log(r.rate / (2 - r.rate))) for r in out if 0 < r.rate < 2 and r.size]
    slopes = {round(y / x, 6) for x, y in free}
    assert len(slopes) <= 2


def test_mixed_documents_repeat_rows(spark):
    docs = documents(spark)
    plan = collections.Counter()
    for r in mixing.mix(docs).collect():
        plan[r.doc_id] += r.copies
    got = mixing.apply_mix(docs)
    assert got.columns == docs.columns
    assert collections.Counter(r.doc_id for r in got.collect()) == +plan
    assert mixing.apply_mix(empty(spark)).count() == 0 and mixing.mix(empty(spark)).count() == 0


def test_fences_do_not_depend_on_partitions(spark):
    rng = random.Random(4)
    rows = [(1000 + i, " ".join("w" * rng.randint(1, 9) + rng.choice(["", "#", "%%"]) for _ in range(rng.randint(1, 60))), rng.choice(["en", "de", None]), rng.choice(["a", "b", None])) for i in range(600)]
    docs = documents(spark, rows)
    seen = []
    for n in (1, 3, 7):
        rated = quality_rules.with_rates(quality_rules.counts(docs.repartition(n)))
        seen.append((sorted(map(repr, quality_rules.fences(rated).collect())), sorted(map(repr, quality_rules.judge(docs.repartition(n)).select("doc_id", "n_words", "kept", "failed_rules").collect()))))
    assert seen[0] == seen[1] == seen[2]


def test_fences_match_brute_force(spark):
    """Exact quantiles of plain lists, within the sketch's relative error, drawn to the language's and the corpus's."""
    rng = random.Random(5)
    rows = [(1000 + i, " ".join("w" * rng.randint(1, 5 if i % 3 else 12) + "#" * (i % 4 == 0) for _ in range(rng.randint(1, 40))), ["en", "de", None][i % 3], ["a", None][i % 2]) for i in range(400)]
    docs = documents(spark, rows)
    rated = quality_rules.with_rates(quality_rules.counts(docs)).filter("n_words > 0").collect()
    prior, error = quality_rules.PRIOR, (quality_rules.GAMMA - 1) / 2 + 1e-9

    def quartile(values, q):
        return sorted(values)[math.ceil(len(values) * q) - 1]

    def drawn(n, own, other):
        return (n * own + prior * other) / (n + prior)

    for f in quality_rules.fences(quality_rules.with_rates(quality_rules.counts(docs))).collect():
        for rate, (least, _, _) in quality_rules.FENCES.items():
            want, slack = {}, 0
            for q in (0.25, 0.75):
                corpus = [r[rate] for r in rated]
                lang = [r[rate] for r in rated if r.lang == f.lang]
                own = [r[rate] for r in rated if (r.lang, r.source) == (f.lang, f.source)]
                want[q] = drawn(len(own), quartile(own, q), drawn(len(lang), quartile(lang, q), quartile(corpus, q)))
                slack += error * max(quartile(own, q), quartile(lang, q), quartile(corpus, q))
            spread = quality_rules.WIDTH * max(want[0.75] - want[0.25], least)
            assert abs(f[f"{rate}_high"] - want[0.75] - spread) <= 4 * slack + 1e-9
            assert abs(f[f"{rate}_low"] - want[0.25] + spread) <= 4 * slack + 1e-9


def test_verdicts_follow_the_fences(spark):
    rng = random.Random(6)
    rows = [(1000 + i, " ".join("word" + "#" * (7 if i % 50 == 0 else 0) for _ in range(rng.randint(1, 40))) + f" {i}", ["en", None][i % 2], "a") for i in range(300)]
    docs = documents(spark, rows)
    rated = quality_rules.with_rates(quality_rules.counts(docs))
    limits = {(f.lang, f.source): f for f in quality_rules.fences(rated).collect()}
    want = []
    for r in rated.collect():
        f, failed = limits.get((r.lang, r.source)), []
        for rate, (_, short, lower) in quality_rules.FENCES.items():
            slack = short / math.sqrt(max(r.n_lines if "line" in rate else r.n_words, 1))
            if f and (r[rate] > f[f"{rate}_high"] + slack or (lower and r[rate] < f[f"{rate}_low"] - slack)):
                failed.append(rate)
        base = r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words
        want.append(repr((r.doc_id, r.n_words, base, failed, not base and not failed)))
    got = [repr((r.doc_id, r.n_words, r.base_failed, r.failed_rules, r.kept)) for r in quality_rules.judge(docs).collect()]
    assert sorted(got) == sorted(want) and any("symbols" in w for w in want)
