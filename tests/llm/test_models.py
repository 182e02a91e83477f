import itertools
import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from dossier.llm import ann, html_text, language_id, quality_classifier, toxicity
from dossier.llm.common import cut, fold, in_sample
from tests.llm.data import documents, empty

WORDS = {"en": "the and of with you walk house water green".split(), "de": "der die und mit haus wasser gehen grün nicht".split(), "fr": "le la et avec vous maison eau vert pas".split()}


def texts(n, seed=0):
    rng = random.Random(seed)
    return [(100 + i, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randint(3, 60))), lang, "a") for i in range(n) for lang in [rng.choice(list(WORDS))]]


def test_folds(spark):
    ids = spark.createDataFrame([(i,) for i in [*range(50), -3]], "doc_id bigint")
    assert all(r.f == zlib.crc32(str(r.doc_id).encode()) % 5 for r in ids.withColumn("f", fold("doc_id", 5)).collect())


def test_language_of_held_out_texts(spark):
    docs = documents(spark, texts(300))
    model = language_id.learn(docs.filter(fold("doc_id", 4) != 2))
    out = language_id.predict(docs, model, keep_text=True).collect()
    assert len(out) == docs.count()
    assert np.mean([r.lang == r.lang_pred for r in out if r.doc_id and r.doc_id >= 100]) > 0.99
    blank = {r.doc_id: (r.lang_pred, r.score) for r in out if r.doc_id in (3, 4, 5, 9)}
    assert set(blank.values()) == {("und", 0.0)}
    assert all(0 <= r.score <= 1 for r in out)


def test_unseen_words_back_off_to_characters(spark):
    docs = documents(spark, texts(300))
    model = language_id.learn(docs)
    out = language_id.predict(spark.createDataFrame([(1, "wassers grünen häuser"), (2, "maisons verte")], "doc_id bigint, text string"), model)
    assert {r.doc_id: r.lang_pred for r in out.collect()} == {1: "de", 2: "fr"}


def plain_language(text, m):
    """Language and score by loops: known words by their row, others by the longest known n-gram at each position."""
    rows = []
    for w in regex.findall(r"\p{L}+", (text or "").lower()):
        if w in m.words:
            rows.append(m.word_scores[m.words[w]].astype(float))
            continue
        spelled, each = f"^{w}$", []
        for p in range(len(spelled)):
            known = [m.grams[spelled[p : p + n]] for n in range(min(language_id.MAX_GRAM, len(spelled) - p), 0, -1) if spelled[p : p + n] in m.grams]
            each.append(m.gram_scores[known[0] if known else -1].astype(float))
        rows.append(np.mean(each, axis=0))
    if not rows:
        return "und", 0.0
    mean = np.mean(rows, axis=0) * min(len(rows), language_id.EVIDENCE)
    odds = np.exp(mean - mean.max())
    return m.langs[int(odds.argmax())], 1 / odds.sum()


def test_language_scores_match_brute_force(spark):
    some = [*texts(60, 5), *((500 + i, t, None, "b") for i, t in enumerate(("½ ² ① Ⅷ 12 _", "x² the ½house", "größe 漢字 наука", "the" * 4000, "Zz qqq", "É" * 50, "٣٤ ٥", "ª º")))]
    docs = documents(spark, some)
    model = language_id.learn(docs)
    assert max(map(len, model.grams)) <= language_id.MAX_GRAM and len(model.langs) == 3
    for r in language_id.predict(docs, model, keep_text=True).collect():
        lang, score = plain_language(r.text, model)
        assert (r.lang_pred, round(r.score, 4)) == (lang, round(score, 4)), r.text
    assert {r.doc_id: r.lang_pred for r in language_id.predict(docs, model).collect()}[500] == "und"


def test_rare_languages_are_learned_beside_a_hot_one(spark):
    spell = lambda i: "".join("abcdefghij"[int(c)] for c in str(i))
    rows = [(i, f"hot{spell(i % 700)} common{spell(i % 311)} word{spell(i)}", "hot", "a") for i in range(3000)] + [(5000 + i, f"rare{spell(i % 3)} seldom", "few", "a") for i in range(6)]
    docs = documents(spark, rows).filter("doc_id >= 1000")
    model = language_id.learn(docs, sample=200, most_words=100, most_grams=400)
    assert model.langs == ["few", "hot"] and {"rarea", "seldom"} <= set(model.words) and len(model.words) <= 100 and len(model.grams) <= 400
    told = language_id.predict(docs.filter("doc_id >= 5000").select("doc_id", "text"), model).collect()
    assert {r.lang_pred for r in told} == {"few"}


def test_language_filter_and_empty_tables(spark):
    docs = documents(spark, texts(60))
    model = language_id.learn(docs)
    kept = language_id.identified(docs, model)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert not ids & {3, 4, 5, 9} and {1, 2, 6, 7, 8} <= ids
    nothing = language_id.learn(empty(spark))
    assert {r.lang_pred for r in language_id.predict(docs, nothing).collect()} == {"und"}
    assert language_id.predict(empty(spark), model).count() == 0


def labelled(spark, n=400):
    rng = random.Random(2)
    rows, labels = [], []
    for i, (d, t, lang, source) in enumerate(texts(n, 3)):
        junk, toxic = i % 5 == 0, i % 7 == 0
        words = t.split()
        if toxic:
            for _ in range(1 + len(words) // 10):
                words.insert(rng.randrange(len(words) + 1), rng.choice(["idiot", "scum", "blorkig", "blorkung", "blorken"]))
        if junk:
            words = [w + "###" for w in words]
        rows.append((d, " ".join(words), lang, source))
        labels.append((d, int(not junk), int(toxic)))
    return documents(spark, rows), spark.createDataFrame([*labels, (None, 1, 1), (99999, 1, 0), (100, None, None)], "doc_id bigint, quality int, toxic int")


@pytest.mark.parametrize("operator, column, least", [(quality_classifier, "quality", 0.3), (toxicity, "toxic", 0.5)])
def test_classifiers_on_held_out_rows(spark, operator, column, least):
    docs, labels = labelled(spark)
    model = operator.learn(docs.filter(fold("doc_id", 5) != 0), labels)
    out = operator.score(docs.select("doc_id", "text", "row"), model)
    assert out.columns == ["doc_id", "row", "score"] and out.count() == docs.count()
    rows = out.join(labels, "doc_id").filter(fold("doc_id", 5) == 0).filter(f"{column} is not null").collect()
    assert np.mean([(r.score >= least) == bool(r[column]) for r in rows]) > 0.95
    assert all(0 <= r.score <= 1 for r in out.collect())
    again = operator.score(docs.select("doc_id", "text"), operator.learn(docs.filter(fold("doc_id", 5) != 0), labels)).collect()
    first = out.collect()
    assert sorted((str(r.doc_id), round(r.score, 6)) for r in again) == sorted((str(r.doc_id), round(r.score, 6)) for r in first)


@pytest.mark.parametrize("operator", [quality_classifier, toxicity])
def test_classifiers_without_labels(spark, operator):
    docs = documents(spark)
    model = operator.learn(docs, spark.createDataFrame([], "doc_id bigint, quality int, toxic int"))
    scores = {r.score for r in operator.score(docs.select("doc_id", "text"), model).collect()}
    assert len(scores) == 1 and 0 <= scores.pop() <= 1
    assert operator.score(empty(spark).select("doc_id", "text"), model).count() == 0


def test_disguised_spellings():
    assert toxicity.undisguised("id1ot") == "idiot" and toxicity.undisguised("st*pid") == "stpid" and toxicity.undisguised("looooser") == "loser"


def cosine_top(rows, k):
    usable = [(i, np.array(v, float)) for i, v in rows if v is not None and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))]
    out = {}
    for i, v in usable:
        if i % 50 == 0:
            scores = sorted((-round(float(v @ w / np.sqrt((v @ v) * (w @ w))), 9), j) for j, w in usable if j != i)
            out[i] = scores[:k]
    return out


def vectors(n, dim=16, seed=0):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(12, dim))
    rows = [(i, (centers[i % 12] + 0.5 * rng.normal(size=dim)).tolist()) for i in range(n)]
    rows += [(10000 + 10 * i, centers[0].tolist()) for i in range(60)] + [(50, rows[7][1])]
    rows += [(9000, None), (9001, [0.0] * dim), (9050, [float("nan")] + [1.0] * (dim - 1)), (9051, [None] + [1.0] * (dim - 1)), (9100, [float("inf")] + [1.0] * (dim - 1))]
    return rows


def test_neighbours_have_high_recall_and_exact_scores(spark):
    rows = [r for i, r in enumerate(vectors(3000)) if not (r[0] == 50 and i == 50)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id bigint, embedding array<float>, label int")
    exact = cosine_top([(r.vec_id, r.embedding) for r in df.collect()], 5)
    got = {}
    for r in ann.search(df, lambda v: v % 50 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(exact)
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == [1, 2, 3, 4, 5] and q not in {v for _, v, _ in found}
        assert all(a >= b - 1e-12 for (_, _, a), (_, _, b) in zip(found, found[1:], strict=False))
        hits += len({v for _, v, _ in found} & {v for _, v in exact[q]})
    assert hits / (5 * len(exact)) >= 0.9
    copies = sorted(v for v, _ in rows if v >= 10000)
    for q in copies:
        if q % 50 == 0:  # of many equal vectors the smallest other ids
            assert [v for _, v, _ in got[q]] == [v for v in copies if v != q][:5]


def test_neighbours_of_few_or_no_vectors(spark):
    schema = "vec_id bigint, embedding array<float>, label int"
    three = spark.createDataFrame([(0, [1.0, 0.0], 0), (1, [1.0, 0.1], 0), (2, [0.0, 1.0], 0)], schema)
    assert [(r.query_id, r.rank, r.vec_id) for r in ann.search(three, lambda v: v % 50 == 0).orderBy("rank").collect()] == [(0, 1, 1), (0, 2, 2)]
    one = spark.createDataFrame([(0, [1.0, 0.0], 0)], schema)
    assert ann.search(one, lambda v: v % 50 == 0).count() == 0
    assert ann.search(spark.createDataFrame([], schema), lambda v: v % 50 == 0).count() == 0


def test_ties_among_parallel_vectors_go_to_smaller_ids(spark):
    base = np.array([0.3, -0.2, 0.9, 0.1])
    rows = [(150 + i, (base * 2.0 ** (i % 7 - 3) * (1 + i // 7)).tolist()) for i in range(40)] + [(i, [float(i), 1.0, 0.0, 2.0]) for i in range(1, 30)]
    rows += [(400, [1.0, 0.0, 0.0, 0.0])] * 9 + [(401 + i, [1.0, 0.0, 0.0, 0.0]) for i in range(6)]  # one id many times
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id bigint, embedding array<double>, label int")

    def score(a, b):
        a, b = np.array([a]), np.array([b])
        return float((b * a).sum(axis=1)[0] / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum(axis=1))[0]))

    by_id = dict(rows)
    want = {q: sorted((-score(by_id[q], v), i) for i, v in by_id.items() if i != q)[:5] for q in by_id if q % 50 == 0}
    got = {}
    for r in ann.search(df, lambda v: v % 50 == 0).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    assert got == want


def test_parts_are_split_again_as_the_table_grows(spark):
    made = vectors(3000)
    rows = [(i, v) for i, v in made if i < 10000 and v and len(v) == len(made[0][1]) and None not in v and np.isfinite(v).all() and any(v)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id bigint, embedding array<float>, label int").dropDuplicates(["vec_id"])
    exact = cosine_top([(r.vec_id, r.embedding) for r in df.collect()], 5)
    groups = cut(ann.distinct_vectors(df.selectExpr("vec_id", "CAST(embedding AS array<double>) AS vector"), 6))
    sent = groups.filter("gid % 50 = 0").selectExpr("gid AS qid", "vector")
    stored, asked = ann.partitioned(groups.select("vector", "ids", "gid"), sent, 200, 20)
    sizes = [r["count"] for r in stored.groupBy("part").count().collect()]
    assert sum(sizes) == groups.count() and np.median(sizes) <= 80
    assert stored.agg({"part": "max"}).collect()[0][0] > ann.RADIX**2  # two levels at least
    assert asked.select("qid").distinct().count() == sent.count()
    found = {}
    for r in ann.search(df, lambda v: v % 50 == 0, sample=400, part_rows=40).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    assert np.mean([len(found[q] & {v for _, v in near}) / 5 for q, near in exact.items()]) >= 0.9


PAGE = """<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">menu</a></li></ul></nav>
<div class="ad">buy now</div><article><h1>Head &amp; one</h1><p><b>First {n}
line<br><p>Second&nbsp;&eacute; {n}</p><div class="comments"><p>nice post</p></div><form><input>send</form></article><aside>side</aside><footer>&copy; foot</footer>{end}"""


def test_article_text_without_boilerplate(spark):
    rows = [(1, "https://h.example/a", PAGE.format(n=1, end="</body></html>")), (2, "https://h.example/b", PAGE.format(n=2, end="</bo")), (3, None, None), (4, "x", ""), (4, "x", ""), (5, "https://h.example/c", "<p>just text &am")]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id bigint, url string, html string, text string")
    out = html_text.extract(pages)
    got = [(r.page_id, r.text, r.n_chars) for r in out.collect()]
    assert out.columns == ["page_id", "url", "text", "n_chars"] and len(got) == 6
    by_id = {i: t for i, t, _ in got}
    assert by_id[1] == "Head & one\n\nFirst 1 line\n\nSecond é 1" and by_id[2] == "Head & one\n\nFirst 2 line\n\nSecond é 2"
    assert by_id[3] == by_id[4] == "" and by_id[5] == "just text &am" and all(n == len(t) for _, t, n in got)
    assert html_text.extract(pages.limit(0)).count() == 0


def plain_blocks(pages, place=html_text.PLAIN):
    return [(list(p), [place] * len(p)) for p in pages]


def plain_texts(pages, share, least):
    """Main texts by looking for every run of RUN words on every distinct page of the host."""
    run, distinct = html_text.RUN, {tuple(p) for p in pages}
    words = [" ".join(p).split(" ") for p in distinct]
    held = Counter(r for w in words for r in {tuple(w[i : i + run]) for i in range(len(w) - run + 1)})
    common = {r for r, n in held.items() if n >= max(least, share * len(distinct))}
    out = []
    for page in pages:
        flat = [(w, k) for k, text in enumerate(page) for w in text.split(" ")]
        gone = {i + j for i in range(len(flat) - run + 1) if tuple(w for w, _ in flat[i : i + run]) in common for j in range(run)}
        kept, i = [], 0
        for text in page:
            flags = [i + j in gone for j in range(len(text.split(" ")))]
            i += len(flags)
            stretches = [(g, len(list(same))) for g, same in itertools.groupby(flags)]
            cut = [g and (n >= run or n == len(flags)) for g, n in stretches for _ in range(n)]
            kept.append(" ".join(w for w, c in zip(text.split(" "), cut, strict=True) if not c))
        out.append("\n\n".join(filter(None, kept)))
    return out


def test_suffixes_are_in_order_with_their_common_prefixes():
    rng = np.random.default_rng(3)
    for n, kinds in ((0, 1), (1, 1), (40, 1), (60, 2), (300, 3), (400, 90)):
        codes = np.append(rng.integers(0, kinds, n), kinds) if n else np.zeros(0, np.int64)
        order, shared = html_text.suffix_array(codes)
        suffixes = [codes[i:].tolist() for i in range(len(codes))]
        assert [suffixes[i] for i in order] == sorted(suffixes)
        prefix = lambda x, y: next((k for k, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
        assert shared.tolist() == [prefix(suffixes[order[k - 1]], suffixes[order[k]]) if k else 0 for k in range(len(order))]


def test_repeated_runs_go_where_markup_is_silent():
    rng = random.Random(6)
    notice = "this site uses little files to keep your settings between visits please agree"
    pages = [[notice, " ".join(f"w{rng.randint(0, 5000)}" for _ in range(80))] for _ in range(12)]
    own = [p[1] for p in pages]
    assert html_text.host_texts(plain_blocks(pages)) == own
    assert html_text.host_texts(plain_blocks(pages, html_text.ARTICLE)) == own
    # in an article, a passage that some pages share stays, and so do pages that are copies
    passage = " ".join(f"p{i}" for i in range(60))
    some = [[p[1]] + ([passage] if i < 5 else []) for i, p in enumerate(pages)]
    assert html_text.host_texts(plain_blocks(some, html_text.ARTICLE)) == ["\n\n".join(p) for p in some]
    same = [[passage, "other " * 19 + "other"]] * 12
    for place in (html_text.PLAIN, html_text.ARTICLE):
        assert html_text.host_texts(plain_blocks(same, place)) == ["\n\n".join(same[0])] * 12
    near = [[passage + f" x{i}"] for i in range(12)]
    assert html_text.host_texts(plain_blocks(near, html_text.ARTICLE)) == [p[0] for p in near]


KEPT = "The engine was overhauled in May."


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (f'<article><p>{KEPT}</p><p class="advert">Buy now</p></article>', [KEPT]),
        (f'<article><p class="cookie-notice">We use cookies<p>{KEPT}</article>', [KEPT]),
        (f'<article><p>{KEPT}</p><ul><li class="comment">Nice<ul><li>inner</li></ul></li><li>Listed</ul></article>', [KEPT, "Listed"]),
        (f'<article><p hidden>secret</p><p>{KEPT}</p></article>', [KEPT]),
        (f'<article><p>{KEPT}</p><h2 class="related">More</h2>tail</article>', [KEPT, "tail"]),
        (f'<article><p>{KEPT} <span class="sponsored">by <span>us</span> all</span>End.</p></article>', [KEPT + " End."]),
        (f'<article><p>{KEPT}<a class="ad"><div>x</div></a></p></article>', [KEPT]),
        (f'<article><table><tr><td class="ad">x<td>{KEPT}<tr class="ad"><td>y</table></article>', [KEPT]),
        (f'<section id="search-engines"><article><p>{KEPT}</p></article></section>', [KEPT]),
        (f'<article><p>{KEPT}</p><div class="share-price">Up 3 %</div></article>', [KEPT, "Up 3 %"]),
        (f'<main><p>Lead.</p><article><p>{KEPT}</p></article><p>After.</p></main>', ["Lead.", KEPT, "After."]),
        (f'<div class="postComments">a</div><div class="ad-1">b</div><div id="relatedPosts">c</div><p>{KEPT}</p>', [KEPT]),
        (f'<div class="nav">m<div>n</div></div><p class="ad">x</div><p>{KEPT}</p>', [KEPT]),
    ],
)
def test_every_element_is_asked(html, want):
    texts, places = html_text.blocks(html)
    assert html_text.main_text(texts, places, np.zeros(0, np.int64), np.zeros(0, np.int64), html_text.Words()) == want


def test_pages_of_boilerplate_alone_are_empty():
    rng = random.Random(4)
    notice = " ".join(f"n{i}" for i in range(30))
    pages = [[notice, " ".join(f"w{rng.randint(0, 5000)}" for _ in range(40))] for _ in range(8)] + [[notice]]
    assert html_text.host_texts(plain_blocks(pages)) == [*(p[1] for p in pages[:8]), ""]


def test_runs_are_what_a_search_of_all_pages_finds():
    rng = random.Random(8)
    word = lambda: f"w{rng.randint(0, 3000)}"
    menu = [f"item{i}" for i in range(11)]  # short blocks: a run spans them
    footer = " ".join(f"f{i}" for i in range(20))
    for n in (1, 2, 3, 9, 40):
        pages = []
        for i in range(n):
            body = [" ".join(word() for _ in range(rng.randint(1, 60))) for _ in range(rng.randint(0, 4))]
            inner = f"{word()} {word()} {footer} {word()}" if i % 3 else " ".join(footer.split()[:7])
            pages.append([*(menu if i % 2 else menu[:5]), *body, inner])
        pages += pages[: n // 4]  # repeated rows count once
        assert html_text.host_texts(plain_blocks(pages)) == plain_texts(pages, *html_text.UNMARKED)
    # the array is what removes the menu: with it off, all of it stays
    assert not any("item3" in t for t in html_text.host_texts(plain_blocks(pages))[1:40:2])


def test_long_repeats_leave_a_short_text():
    long = " ".join(f"q{i}" for i in range(50))
    pages = [[long, f"own {i} text"] for i in range(12)]
    assert html_text.host_texts(plain_blocks(pages)) == [f"own {i} text" for i in range(12)]


def test_held_out_pages_without_names(spark):
    """Menus, notices and footers in plain boxes, and headings in boxes named after their article."""
    rng = random.Random(12)
    menu = "".join(f"<div>menu{i}</div>" for i in range(9))
    foot = "<div>" + " ".join(f"foot{i}" for i in range(15)) + "</div>"
    rows, want = [], {}
    for i in range(40):
        head, body = f"Heading {i} of {rng.random()}", " ".join(f"w{rng.randint(0, 9000)}" for _ in range(50))
        inner = f'<div class="post-header"><h1>{head}</h1></div><p>{body}</p>'
        page = f"<article><header><h1>{head}</h1></header><p>{body}</p></article>" if i % 4 == 0 else f'<div class="site-header">Site {i}</div>{inner}'
        rows.append((i, f"https://h.example/{i}", f"<html><body>{menu}{page}{foot}</body></html>"))
        want[i] = f"{head}\n\n{body}"
    out = html_text.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string"), group=8).collect()
    assert {r.page_id: r.text for r in out} == want


def test_runs_are_counted_over_the_whole_host(spark):
    rng = random.Random(9)
    own = lambda: " ".join(f"w{rng.randint(0, 5000)}" for _ in range(150))
    passages = [" ".join(f"p{k}x{j}" for j in range(12)) for k in range(12)]
    holders = [set(rng.sample(range(300), 45 + 3 * k)) for k in range(12)]  # 15 % to 26 % of the pages
    held = [[p for p, some in zip(passages, holders, strict=True) if i in some] for i in range(300)]
    blocks = [[*few, own()] for few in held]
    rows = [(i, f"https://h.example/{i}", "".join(f"<div>{b}</div>" for b in page)) for i, page in enumerate(blocks)]
    want = dict(enumerate(html_text.host_texts(plain_blocks(blocks))))
    assert list(want.values()) == plain_texts(blocks, *html_text.UNMARKED)
    assert any(passages[0] in t for t in want.values()) and not any(passages[-1] in t for t in want.values())
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    for group in (16, 64):
        assert {r.page_id: r.text for r in html_text.extract(pages, group=group).collect()} == want


def test_repeated_rows_are_one_page_of_a_group(spark):
    rng = random.Random(4)
    notice = " ".join(f"n{i}" for i in range(12))
    blocks = [[*([notice] if i < 180 else []), " ".join(f"w{rng.randint(0, 5000)}" for _ in range(60))] for i in range(300)] + [["copy " * 30 + "end"]] * 900
    want = html_text.host_texts(plain_blocks(blocks))
    assert want[0] == blocks[0][1]
    rows = [(None, None, "".join(f"<div>{b}</div>" for b in page)) for page in blocks]  # rows of one key
    for some in (rows, rows[::-1]):
        pages = spark.createDataFrame(some, "page_id bigint, url string, html string").coalesce(2)
        assert sorted(r.text for r in html_text.extract(pages).collect()) == sorted(want)
    dealt = pages.selectExpr("html", "'' AS host", "19 AS parts").mapInArrow(html_text._contents, html_text.CONTENTS)
    assert dealt.count() <= 302 and dealt.groupBy("part").count().agg({"count": "max"}).collect()[0][0] <= html_text.GROUP


def test_a_very_long_page(spark):
    body = " ".join(f"w{i}" for i in range(300_000))
    pages = spark.createDataFrame([(1, "https://h.example/", f"<article><p>{body}</p></article>"), (1, "https://h.example/", f"<p>{body}")], "page_id bigint, url string, html string")
    assert [r.text for r in html_text.extract(pages).collect()] == [body, body]


def test_quality_reads_the_middle_of_long_words(spark):
    q = quality_classifier

    def plain(text):
        """Buckets of the whole words and their n-grams, by loops over Python integers."""
        out, before = Counter(), None
        for w in text.split():
            h = sum(ord(c) * pow(int(q.WORD_ROLL), i, 1 << 64) for i, c in enumerate(w + " "))
            out[(h * int(q.WORD_MIX) % (1 << 64)) >> (64 - q.BUCKET_BITS)] += 1
            spaced = f" {w} "
            for n in q.GRAMS:
                for i in range(len(spaced) - n + 1):
                    r = 0
                    for c in spaced[i : i + n]:
                        r = (r * int(q.ROLL) + ord(c)) % (1 << 32)
                    out[((r + n) * int(q.MIX) % (1 << 32)) >> (32 - q.BUCKET_BITS)] += 1
            out[q.AGAIN] += q.AGAIN_WEIGHT * (w == before)
            before = w
        return +out

    rng = random.Random(2)
    made = ["".join(rng.choice("abcdeé漢😀") for _ in range(size)) for size in (1, 2, 3, 22, 60, 1023, 5000, q.BLOCK - 3, q.BLOCK - 1, q.BLOCK + 1)]
    some = [*made, "", " \t\n ", " a  a\ta b ", "é é é 漢", " ".join(made[:6]), "a " * 3000]
    found = [Counter(dict(zip(ids.tolist(), n.tolist(), strict=True))) for ids, n in q.feature_counts(some)]
    assert found == [plain(t) for t in some]
    # scores: brute force over those counts, and the same for one text as for many
    values = np.random.default_rng(1).normal(size=q.BUCKETS)
    total, n = q.feature_sums(some, values)
    assert n.tolist() == [sum(c.values()) for c in found]
    assert np.allclose(total, [sum(values[b] * k for b, k in c.items()) for c in found])
    model = q.train([(ids, k, i % 2) for i, (ids, k) in enumerate(q.feature_counts(some))])
    for t, c, s in zip(some, found, q.scores(some, model, q.margins(model)), strict=True):
        mean = sum(model.vectors[b].astype(float) * k for b, k in c.items()) / sum(c.values()) if c else None
        assert abs(s - (q.softmax(mean @ model.weights + model.bias)[1] if c else model.prior)) < 1e-5
    # unspaced documents that differ in the middle only
    text = lambda junk, n: "a" * 20 + "".join(rng.choice("xyz" if junk else "klm") for _ in range(n)) + "b" * 8
    rows = [(1000 + i, text(i % 2, 3000 if i % 5 == 0 else 80), "en", "a") for i in range(200)]
    docs = documents(spark, rows).filter("doc_id >= 1000")
    labels = spark.createDataFrame([(d, d % 2) for d, *_ in rows], "doc_id bigint, quality int")
    model = quality_classifier.learn(docs.filter("doc_id < 1150"), labels)
    out = quality_classifier.score(docs.filter("doc_id >= 1150").select("doc_id", "text"), model).collect()
    assert len(out) == 50 and all((r.score >= 0.5) == bool(r.doc_id % 2) for r in out)


def test_samples_of_any_size(spark):
    """Of 10 ** 11 rows the share is a part of 2 ** 62, not of a million: some rows are chosen, and of few rows all."""
    rows = spark.range(2_000_000)
    chosen = lambda bound, n: rows.filter(in_sample(F.col("id"), bound, F.lit(n))).count()
    assert 1000 < chosen(10**8, 10**11) < 3000 and 19_000 < chosen(10_000, 10**6) < 21_000
    assert chosen(4000, 10**11) < 10 and chosen(3_000_000, 2_000_000) == 2_000_000


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test data")
def test_queries_search_some_parts_only(spark):
    """On the given vectors, which lie evenly in all directions: fewer parts than there are, recall of 0.9 and more."""
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    groups = cut(ann.distinct_vectors(df.selectExpr("vec_id", "CAST(embedding AS array<double>) AS vector"), 6))
    sent = groups.filter("gid % 50 = 0").selectExpr("gid AS qid", "vector")
    stored, asked = ann.partitioned(groups.select("vector", "ids", "gid"), sent, ann.SAMPLE, ann.PART_ROWS)
    parts = stored.select("part").distinct().count()
    assert parts >= 8 and asked.count() < 0.95 * parts * sent.count()
    x = {r.gid: np.array(r.vector) for r in groups.collect()}
    ids = sorted(x)
    u = np.array([x[i] / np.linalg.norm(x[i]) for i in ids])
    found, hits = {}, 0
    for r in ann.search(df, lambda v: v % 50 == 0).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    for q, got in found.items():
        near = u @ u[ids.index(q)]
        near[ids.index(q)] = -1
        hits += len(got & {ids[j] for j in np.argsort(-near)[:5]})
    assert hits >= 0.9 * 5 * len(found)
