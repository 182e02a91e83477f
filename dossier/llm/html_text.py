"""Main text of web pages by a suffix array over each host's pages, with markup for what no repeat can show.

Each page is cut into blocks of text. The token streams of a host's distinct pages, told apart by a digest of their blocks,
are concatenated; their suffixes are sorted and the lengths of their common prefixes taken, so that the suffixes that share
their first RUN tokens or more lie side by side: these are the long substrings, and the pages they come from are counted.
Runs may span blocks. A page loses the blocks, and the stretches of RUN tokens or more of a block, that are covered by runs
which enough of its host's distinct pages hold. It keeps its unique runs; a page of shared runs alone has an empty text.

A host may have any share of the pages, so its pages are dealt by their digest into groups of about GROUP, each with a suffix
array of its own that reports the runs held by at least REPORTED of its pages. Added up over the host, the reports bound the
number of distinct pages that hold a run; where the bounds leave open whether it is enough, the pages are counted again for
that run. The result is that of one array over the whole host.

Markup decides the rest: blocks inside menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles or reader
comments (by element, role, or class and id of any element) go, even where their words differ on each page. A class or id counts
if it names nothing else. Of the others, those inside <main> (else <article>) are the page's main part; without either, all are. In a main part only runs that nearly all pages
hold go, and only if over half of the part stays: a passage that some pages share, or pages that are near copies of each
other, keep their article.

Defined cases: null or empty html has an empty text; a null url belongs to one nameless host; repeated rows are rows of
their own and count once as pages; hosts of fewer pages than the least numbers of MARKED and UNMARKED lose no run; a very
long page is cut as a whole, in the task that holds its group; ties do not arise, as runs are chosen by counts alone; other
columns of pages are left out, whatever their names; an empty table gives an empty result. No group holds over a few times
GROUP different pages, and equal pages reach it once for each task that read them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator, Sequence
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.common import cut

GROUP = 64  # pages
RUN = 8  # tokens
MOST_SEEN = 500_000  # digests that a task remembers
REPORTED = 0.1  # of a group's pages: runs that fewer hold are not reported
#: share of the host's distinct pages, and how many at least, that hold a run of boilerplate: in a main part, elsewhere
MARKED, UNMARKED = (0.9, 8), (0.2, 3)

#: Elements and class or id words by their meaning in HTML.
RAW = "script|style|noscript|template|svg|iframe|textarea|select|object|canvas|audio|video|title|button"
SKIPPED = frozenset("nav header footer aside form dialog menu fieldset".split())
BLOCKS = frozenset(
    """address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul""".split()
)
CONTAINERS = BLOCKS - frozenset("p hr li dt dd td th tr tbody thead tfoot h1 h2 h3 h4 h5 h6 body html head".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
WHOLE = frozenset("html head body".split())
#: What ends an element whose end tag may be missing, when it opens beside it.
ENDED_BY = {
    **dict.fromkeys("p h1 h2 h3 h4 h5 h6".split(), BLOCKS),
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"},
    "tr": {"tr", "tbody", "tfoot"}, "tbody": {"tbody", "tfoot"}, "thead": {"tbody", "tfoot"}, "tfoot": {"tbody"},
}
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: Words that name what is no main text, and words that may stand beside them in a class or id without changing that.
NAMES = frozenset(
    """ad ads advert adverts advertisement advertisements advertising sponsor sponsors sponsored promo promos promotion banner banners cookie cookies
    consent gdpr notice notices newsletter newsletters subscribe popup modal sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs
    footer share sharing social related recommended recommendations comment comments respond disqus reply replies login signup search pagination
    pager""".split()
)
BESIDE = frozenset(
    """area article articles bar block blog body bottom box btn button buttons by center col column container content div entry feed fixed float form
    global group hero holder icon icons inline inner item items js label left line link links list main message middle module native news outer page
    panel pane policy post posts primary reader right row secondary section side site slot small stories sticky story text thread title top unit up user users
    widget widgets wrap wrapper""".split()
)
PARTS = re.compile("[a-z]+|[0-9]+", re.I)
CAPITAL = re.compile("(?<=[a-z])(?=[A-Z])")
#: Names of a whole page's header and its boxes; the header of an article holds its heading and stays.
PAGE_NAMES = re.compile(r"(?:^|\s)(?:(?:site|page|top|main|global|blog|sticky)[_-]?)?(?:header|masthead|topbar|widgets?)(?=$|\s)", re.I)
TOKEN = re.compile(
    rf"""<!--.*?(?:-->|\Z)|<({RAW})(?=[\s/>])(?:[^>"']++|"[^"]*+"|'[^']*+')*+>.*?(?:</\1\s*>|\Z)|"""
    r"""<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>|<[!?/][^>]*>|<[a-zA-Z/!][^<>]*\Z""",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role|aria-hidden|hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def named(value: str) -> bool:
    """Whether one of the names in a class or id says that an element is no main text: a listed word, with others that do not change it.

    `comment-list` does; `share-price` and `search-engines` name something else.
    """
    for name in value.split():
        parts = [p.lower() for p in PARTS.findall(CAPITAL.sub("-", name)) if not p.isdigit()]
        if any(p in NAMES for p in parts) and all(p in NAMES or p in BESIDE for p in parts):
            return True
    return False


def skipped(name: str, attributes: str, in_main: bool) -> bool:
    """Whether an element and all in it are not main text."""
    if name in SKIPPED and not (in_main and name == "header"):
        return True
    for key, value in ATTRIBUTE.findall(attributes) if attributes else ():
        key, value = key.lower(), value.strip("\"'")
        if key in ("class", "id") and (named(value) or (not in_main and PAGE_NAMES.search(value))):
            return True
        if (key == "role" and value.lower() in ROLES) or key == "hidden":
            return True
        if (key == "aria-hidden" and value.lower() == "true") or (key == "style" and HIDDEN.search(value)):
            return True
    return False


#: Where a block lies: in what markup names as no main text, outside a main part, in <main>, in an article.
SKIP, PLAIN, MAIN, ARTICLE = range(4)


def blocks(html: str) -> tuple[list[str], list[int]]:
    """Texts of the page's blocks in order, and where each lies. Paragraphs, items, cells, headings and inline elements that are no main text are left out."""
    texts, places = [], []
    parts: list[str] = []
    stack: list[tuple[str, bool, int]] = []  # open containers: name, skipped, place
    at, skip, place = 0, False, PLAIN
    hushed, depth, base = "", 0, 0  # an open element that is left out: its name, how deep that is nested, the containers around it

    def close() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                texts.append(text)
                places.append(SKIP if skip else place)

    for m in TOKEN.finditer(html):
        if m.start() > at and not hushed:
            parts.append(unescape(html[at : m.start()]))
        at = m.end()
        name = (m[3] or m[6] or "").lower()
        if not name:
            continue
        closing, attributes = bool(m[2] or m[5]), m[4] or m[7] or ""
        block = name in BLOCKS
        if hushed and block and not closing and len(stack) == base and name in ENDED_BY.get(hushed, ()):
            hushed = ""
        if hushed and name == hushed:
            depth += -1 if closing else 1
            if depth == 0:
                hushed = ""
                if block:
                    close()
                continue
        if name == "br" and not hushed:
            parts.append(" ")
        if not block:
            if not (closing or hushed or name in VOID or attributes.endswith("/")) and skipped(name, attributes, place > PLAIN):
                hushed, depth, base = name, 1, len(stack)
            continue
        close()
        if closing:
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), None)
            if k is not None:
                del stack[k:]
                _, skip, place = stack[-1] if stack else ("", False, PLAIN)
                if len(stack) < base:
                    hushed = ""
        elif name in VOID or attributes.endswith("/"):
            continue
        elif name in CONTAINERS:
            kind = ARTICLE if name == "article" else MAIN if name == "main" or 'role="main"' in attributes else PLAIN
            skip, place = skip or skipped(name, attributes, place > PLAIN), max(place, kind)
            stack.append((name, skip, place))
        elif not hushed and name not in WHOLE and skipped(name, attributes, place > PLAIN):
            hushed, depth, base = name, 1, len(stack)
    if at < len(html) and not hushed:
        parts.append(unescape(html[at:]))
    close()
    return texts, places


def suffix_array(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The starts of the suffixes in order, and how long a prefix each shares with the one before it (0 for the first).

    Prefix doubling: ranks by the first token, then by the first 2, 4, 8, ... until all differ. The ranks of each depth are
    kept, as they tell whether two suffixes share so many tokens: the common prefix is put together from the longest down.
    """
    n = len(codes)
    ranks, depth = [np.unique(codes, return_inverse=True)[1].astype(np.int64)], 1
    while int(ranks[-1].max(initial=-1)) + 1 < n:
        ahead = np.concatenate((ranks[-1][depth:] + 1, np.zeros(min(depth, n), np.int64)))
        ranks.append(np.unique(ranks[-1] * (n + 1) + ahead, return_inverse=True)[1].astype(np.int64))
        depth *= 2
    order = np.argsort(ranks[-1])
    a, b, shared = order[:-1].copy(), order[1:].copy(), np.zeros(n, np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        rank = np.append(ranks[k], -1)  # past the end nothing is shared
        same = (rank[np.minimum(a, n)] == rank[np.minimum(b, n)]) & (np.maximum(a, b) + (1 << k) <= n)
        step = same * (1 << k)
        a, b = a + step, b + step
        shared[1:] += step
    return order, shared


def run_hashes(tokens: np.ndarray) -> np.ndarray:
    """For each position from which RUN tokens follow a hash of these, the same in every process."""
    mixed, depth = tokens.astype(np.uint64), 1
    while depth < RUN:
        ahead = np.concatenate((mixed[depth:], np.zeros(min(depth, len(mixed)), np.uint64)))
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + ahead
        depth *= 2
    return mixed.view(np.int64)[: max(len(tokens) - RUN + 1, 0)]


class Words:
    """A 64-bit hash of each word, never 0. Forgets all once it holds too many."""

    def __init__(self, most: int = 300_000):
        self.known: dict[str, int] = {}
        self.most = most

    def stream(self, page: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of the page's words, and the block of each."""
        if len(self.known) > self.most:
            self.known.clear()
        flat, sizes = [], []
        for text in page:
            words = text.split(" ")
            for w in words:
                if (h := self.known.get(w)) is None:
                    h = self.known[w] = int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") or 1
                flat.append(h)
            sizes.append(len(words))
        return np.array(flat, np.uint64), np.repeat(np.arange(len(page)), sizes)


def run_counts(pages: Sequence[Sequence[str]], words: Words, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the runs that at least `least` of different pages hold, and how many of the pages hold each."""
    streams = [words.stream(page)[0] for page in pages]
    if not any(map(len, streams)):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # each page ends in a token of its own, so no common prefix reaches beyond a page
    codes = np.unique(np.concatenate(streams), return_inverse=True)[1].astype(np.int64)
    ends = np.cumsum([len(x) for x in streams])
    codes = np.insert(codes, ends, len(codes) + np.arange(len(pages)))
    sizes = np.array([len(x) + 1 for x in streams])
    page_of = np.repeat(np.arange(len(pages)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - 1 - np.arange(len(codes))  # tokens of the page from each position on
    order, shared = suffix_array(codes)
    group = np.cumsum(shared < RUN) - 1  # neighbours that share a run
    pairs = np.unique((group * len(pages) + page_of[order])[left[order] >= RUN])
    held = np.bincount(pairs // len(pages), minlength=int(group[-1]) + 1)
    first = np.full(len(held), -1)
    first[group[::-1]] = order[::-1]
    enough = np.flatnonzero(held >= max(least, 1))
    hashed = np.concatenate([np.append(run_hashes(x), np.zeros(min(len(x), RUN - 1) + 1, np.int64)) for x in streams])
    return hashed[first[enough]], held[enough]


def covered(hashed: np.ndarray, runs: np.ndarray, block_of: np.ndarray) -> np.ndarray:
    """Which of a page's tokens the given runs cover, as whole blocks or as RUN tokens or more of a block.

    A run that spans blocks may end in the first word of the next one, which is not boilerplate for that.
    """
    size = len(block_of)
    if not len(runs) or not len(hashed):
        return np.zeros(size, bool)
    gone = np.convolve(np.isin(hashed, runs), np.ones(RUN, np.int64))[:size] > 0
    edge = np.flatnonzero(np.concatenate(([True], (gone[1:] != gone[:-1]) | (block_of[1:] != block_of[:-1]))))
    length = np.diff(np.append(edge, size))
    long = (length >= RUN) | (length == np.bincount(block_of)[block_of[edge]])
    return gone & np.repeat(long, length)


def main_text(page: Sequence[str], places: Sequence[int], inside: np.ndarray, elsewhere: np.ndarray, words: Words) -> list[str]:
    """The blocks of the main text; inside, elsewhere: the host's runs of boilerplate in a main part and out of it."""
    best = max(places, default=SKIP)
    if best == SKIP:
        return []
    best = MAIN if MAIN in places else best  # all of <main>, with what of it lies outside its article
    runs = inside if best > PLAIN else elsewhere
    mine = [t for t, p in zip(page, places, strict=True) if p >= best]
    if not len(runs):
        return mine
    tokens, block_of = words.stream(page)
    gone = covered(run_hashes(tokens), runs, block_of)
    asked = np.array(places)[block_of] >= best
    n, left = int(asked.sum()), int((asked & ~gone).sum())
    if left == n or (best > PLAIN and 2 * left <= n):
        return mine
    out, at = [], 0
    for text, place in zip(page, places, strict=True):
        parts = text.split(" ")
        if place >= best:
            flags = gone[at : at + len(parts)]
            kept = " ".join(w for w, g in zip(parts, flags.tolist(), strict=True) if not g) if flags.any() else text
            out += [kept] if kept else []
        at += len(parts)
    return out


def host_texts(pages: list[tuple[list[str], list[int]]]) -> list[str]:
    """The main texts of a whole host's pages (blocks and places), by one suffix array."""
    words, contents = Words(), list(dict.fromkeys(tuple(page) for page, _ in pages))
    runs, held = run_counts(contents, words, UNMARKED[1])
    inside, elsewhere = (runs[held >= max(least, np.ceil(share * len(contents)))] for share, least in (MARKED, UNMARKED))
    return ["\n\n".join(main_text(page, places, inside, elsewhere, words)) for page, places in pages]


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[tuple[list[str], list[int]]]]]:
    for b in batches:
        for k in range(0, b.num_rows, 200):
            part = b.slice(k, 200)
            yield part, [blocks(h or "") for h in part.column("html").to_pylist()]


def digest(page: Iterable[str]) -> bytes:
    return hashlib.blake2b("\0".join(page).encode("utf-8", "surrogatepass"), digest_size=16).digest()


CONTENTS = "host string, part int, parts int, content binary, blocks array<string>"


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks of the pages, dealt by their digest; of a host's equal pages in a task, one."""
    seen: set[tuple[str, bytes]] = set()
    for b, parsed in _parsed(batches):
        if len(seen) > MOST_SEEN:
            seen.clear()
        rows = []
        for host, parts, (page, _) in zip(b.column("host").to_pylist(), b.column("parts").to_pylist(), parsed, strict=True):
            content = digest(page)
            if (host, content) not in seen:
                seen.add((host, content))
                rows.append((host, int.from_bytes(content[:8], "little") % parts, parts, content, page))
        columns = zip(*rows) if rows else [()] * 5
        kinds = pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["host", "part", "parts", "content", "blocks"])


def _group_runs(group: pa.Table) -> pa.Table:
    """The number of different pages (run null), and the reported runs; slack: how many more pages may hold an unreported run."""
    pages = dict(zip(group["content"].to_pylist(), group["blocks"].to_pylist(), strict=True))
    n, whole = len(pages), group["parts"][0].as_py() == 1
    share, least = UNMARKED if whole else (REPORTED, 1)
    least = max(least, int(np.ceil(share * n)))
    runs, held = run_counts([pages[c] for c in sorted(pages)], Words(), least)
    return pa.table({
        "host": pa.array([group["host"][0].as_py()] * (len(runs) + 1), pa.string()), "run": pa.array([None, *runs.tolist()], pa.int64()),
        "n": pa.array([n, *held.tolist()], pa.int64()), "slack": pa.array([0 if whole else least - 1] * (len(runs) + 1), pa.int64()),
    })


def _holding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, content, run: which of the asked runs a page holds."""
    words = Words()
    for b in batches:
        hosts, contents, runs = [], [], []
        for host, content, page, asked in zip(*(b.column(c).to_pylist() for c in ("host", "content", "blocks", "asked")), strict=True):
            tokens, _ = words.stream(page)
            held = np.intersect1d(run_hashes(tokens), np.array(asked, np.int64)).tolist()
            hosts += [host] * len(held)
            contents += [content] * len(held)
            runs += held
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(contents, pa.binary()), pa.array(runs, pa.int64())], names=["host", "content", "run"])


def common_runs(contents: DataFrame) -> DataFrame:
    """host, inside, elsewhere: the runs of boilerplate in a main part and in pages without one; contents: as CONTENTS."""
    told = cut(contents.groupBy("host", "part").applyInArrow(_group_runs, "host string, run bigint, n bigint, slack bigint"), "runs")
    size = told.filter("run is null").groupBy("host").agg(F.sum("n").alias("pages"), F.sum("slack").alias("slack")).filter(F.col("pages") >= UNMARKED[1])
    held = told.filter("run is not null").groupBy("host", "run").agg(F.sum("n").alias("low"), F.sum("slack").alias("counted")).join(size, "host")
    high = F.col("low") + F.col("slack") - F.col("counted")
    need = lambda rule: F.greatest(F.lit(rule[1]), F.ceil(F.lit(rule[0]) * F.col("pages")))
    doubt = lambda rule: (F.col("low") < need(rule)) & (need(rule) <= high)
    known = cut(held.filter(high >= need(UNMARKED)).select("host", "run", "pages", "low", (doubt(MARKED) | doubt(UNMARKED)).alias("doubt")), "held")
    asked = known.filter("doubt").groupBy("host").agg(F.collect_set("run").alias("asked"))
    if not asked.isEmpty():
        pairs = contents.join(asked, "host").select("host", "content", "blocks", "asked").mapInArrow(_holding, "host string, content binary, run bigint").distinct()
        known = known.join(pairs.groupBy("host", "run").agg(F.count("*").alias("exact")), ["host", "run"], "left").withColumn("low", F.coalesce("exact", "low"))
    enough = lambda rule: F.collect_set(F.when(F.col("low") >= need(rule), F.col("run")))
    # written, so its size is known when the join is planned
    return cut(known.groupBy("host").agg(enough(MARKED).alias("inside"), enough(UNMARKED).alias("elsewhere")), "common")


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words, none = Words(), np.zeros(0, np.int64)
    for b, parsed in _parsed(batches):
        runs = [[none if (r := b.column(c)[i].values) is None else r.to_numpy() for c in ("inside", "elsewhere")] for i in range(b.num_rows)]
        texts = ["\n\n".join(main_text(page, places, *both, words)) for (page, places), both in zip(parsed, runs, strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", group: int = GROUP) -> DataFrame:
    """page_id, url, text and n_chars (its code points) for each row of pages."""
    host = F.lower(F.coalesce(F.regexp_extract(F.col(url_col), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    keyed = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host.alias("host"))
    # the table of hosts with over one group is written, so its size is known when the join is planned
    large = cut(keyed.groupBy("host").agg(F.count("*").alias("n")).filter(F.col("n") > group).select("host", F.ceil(F.col("n") / group).cast("int").alias("parts")), "hosts")
    dealt = keyed.join(large, "host", "left").select("html", "host", F.coalesce("parts", F.lit(1)).alias("parts"))
    common = common_runs(dealt.mapInArrow(_contents, CONTENTS))
    kind = pages.schema[id_col].dataType.simpleString()
    return keyed.join(common, "host", "left").select("page_id", "url", "html", "inside", "elsewhere").mapInArrow(_texts, f"page_id {kind}, url string, text string, n_chars bigint")
