"""Text kernels as Column expressions. Unicode classes are asked for with (?U) where words may hold any letter."""

from __future__ import annotations

import functools
import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


#: What is removed from input, what is hidden in errors, and what of HTML becomes what.
CONTROL_CHARACTERS = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]"
OVERRIDES = r"(?i)(ignore|disregard|forget).{0,20}(instructions|above|previous|system)"
SECRETS = (r"(?i)(Bearer\s+|sk-|api[_-]?key[=:]\s*)[^\s\"']+", r"(postgres://|mysql://|https?://[^@\s]+@)[^\s\"']+")
HTML_STEPS = (
    (r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>", ""),
    (r"""(?i)<a[^>]*href=['"]([^'"]+)['"][^>]*>([^<]*)</a>""", "[$2]($1)"),
    (r"(?i)<a[^>]*>([^<]*)</a>", "$1"),
    (r"(?i)<(br|p|div|h[1-6]|li)[^>]*>", "\n"),
    (r"<[^>]+>", ""),
)


def normal_name(name: Column) -> Column:
    """For matching names: lower case, punctuation to one space, white space collapsed; underscores stay."""
    spaced = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"(?U)[^\w\s]+", " ")
    return F.trim(F.regexp_replace(spaced, r"(?U)\s+", " "))


def sanitized(text: Column, longest: int = 500) -> Column:
    """Control characters and phrases that try to override instructions removed, then cut and trimmed."""
    plain = F.regexp_replace(F.regexp_replace(text, CONTROL_CHARACTERS, ""), OVERRIDES, "")
    return stripped(F.substring(plain, 1, longest))


def stripped(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def redacted_error(message: Column, longest: int = 500) -> Column:
    """Secrets in an error message replaced, then cut."""
    return F.substring(functools.reduce(lambda c, p: F.regexp_replace(c, p, "$1[REDACTED]"), SECRETS, message), 1, longest)


def safe_file_name(name: Column, longest: int = 255) -> Column:
    return F.substring(F.translate(F.replace(name, F.lit("\x00"), F.lit("")), '/\\<>:"|?*', "_________"), 1, longest)


def without_nul(text: Column) -> Column:
    return F.replace(text, F.lit("\x00"), F.lit(""))


def find_anchor(text: Column, anchor: Column, end: bool = False) -> Column:
    """0-based position of the anchor words: exact, then in any case, then over any white space; null if absent."""
    exact = F.nullif(F.instr(text, anchor), F.lit(0))
    folded = F.nullif(F.instr(F.lower(text), F.lower(anchor)), F.lit(0))
    escaped = F.regexp_replace(anchor, r"([\\\[\](){}.*+?^$|])", r"\\$1")
    loose = F.concat(F.lit("(?i)"), F.regexp_replace(F.trim(escaped), r"\s+", r"\\s+"))
    found = F.nullif(F.regexp_instr(text, loose), F.lit(0))
    length = F.when(F.coalesce(exact, folded).isNotNull(), F.length(anchor)).otherwise(F.length(F.regexp_substr(text, loose)))
    at = F.coalesce(exact, folded, found) - 1
    return F.when(anchor != "", at + length if end else at)


def address_of(header: Column) -> Column:
    """The address in `Name <address>`, or the header itself."""
    inside = F.regexp_extract(header, "<([^<>]+)>", 1)
    return F.lower(F.trim(F.when(inside != "", inside).otherwise(header)))


def address_list(header: Column) -> Column:
    return F.filter(F.transform(F.split(header, "[,;]"), address_of), lambda a: F.contains(a, F.lit("@")))


@F.pandas_udf(StringType())
def decode_entities(text: pd.Series) -> pd.Series:
    """Character references of HTML; no built-in function knows their names."""
    return text.map(lambda t: html.unescape(t) if t is not None and "&" in t else t)


def strip_tags(markup: Column) -> Column:
    """Scripts and styles removed, links as markdown, block elements as line breaks, other tags removed."""
    return functools.reduce(lambda c, step: F.regexp_replace(c, *step), HTML_STEPS, markup)


def html_to_text(markup: Column) -> Column:
    return stripped(F.regexp_replace(decode_entities(strip_tags(markup)), r"\n\s*\n", "\n\n"))


_ALT = r"((?:[^\]]|\](?!\())*+)"
#: Image references that parsers leave behind, in the order in which they are removed.
IMAGE_REFERENCES = (
    r'<img\s+[^>]*alt="([^"]*)"[^>]*/?>',
    rf"!?\[{_ALT}\]\(page_\d+_\w+[^)]*\)",
    rf"!?\[{_ALT}\]\(layout(?:_\w+)*\)",
    rf"!?\[{_ALT}\]\(image\)",
    rf"!\[{_ALT}\]\(image_\d+\.(?:png|jpe?g)\)",
    rf"!\[{_ALT}\]\([^)/.#:?&]+\)",
)


def without_image_references(text: Column) -> Column:
    for pattern in IMAGE_REFERENCES:
        text = F.regexp_replace(text, pattern, "$1")
    return text


def has_image_references(text: Column) -> Column:
    out = F.lit(False)
    for pattern in IMAGE_REFERENCES:
        out = out | F.regexp_like(text, F.lit(pattern))
    return out


def table_row(cells: Column, width: int | Column | None = None) -> Column:
    """One row of a markdown table: cells trimmed, pipes escaped, padded to width."""
    safe = F.transform(cells, lambda c: F.replace(F.trim(F.coalesce(c, F.lit(""))), F.lit("|"), F.lit("\\|")))
    if width is not None:
        width = F.lit(width) if isinstance(width, int) else width
        safe = F.concat(safe, F.array_repeat(F.lit(""), F.greatest(width - F.size(cells), F.lit(0))))
    return F.concat(F.lit("| "), F.array_join(safe, " | "), F.lit(" |"))


def markdown_table(rows: Column) -> Column:
    """A markdown table from array<array<string>>; the first row is its header. Null for no rows."""

    def table(width: Column) -> Column:
        rule = F.concat(F.lit("|"), F.array_join(F.array_repeat(F.lit("---"), width), "|"), F.lit("|"))
        return F.array_join(F.transform(rows, lambda r, i: F.when(i == 0, F.concat(table_row(r, width), F.lit("\n"), rule)).otherwise(table_row(r, width))), "\n")

    # an array of one element binds the width, which every row uses
    return F.when(F.size(rows) > 0, F.transform(F.array(F.array_max(F.transform(rows, lambda r: F.size(r)))), table)[0])


def citations(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\[C:([a-f0-9]+)\]"), F.lit(1))


def cite_tag(chunk: Column, source: Column, title: Column, page: Column, line_from: Column, line_to: Column, download: Column, index: Column) -> Column:
    """The element that stands for one validated citation."""
    attribute = lambda name, value: F.concat(F.lit(f'{name}="'), value.cast("string"), F.lit('"'))
    parts = F.concat_ws(
        " ", attribute("id", chunk), attribute("doc", F.nullif(source, F.lit(""))), attribute("title", F.nullif(F.replace(title, F.lit('"'), F.lit("&quot;")), F.lit(""))),
        attribute("page", F.nullif(page, F.lit(0))), attribute("lines", F.concat_ws("-", F.when(line_to.isNotNull(), line_from), line_to)) if line_from is not None else None,
        attribute("download", F.regexp_replace(download, "^/archive/", "")),
    )
    return F.concat(F.lit("<cite "), parts, F.lit(">"), index.cast("string"), F.lit("</cite>"))


def line_of(text: Column, position: Column) -> Column:
    """1-based line of a 0-based position."""
    before = F.substring(text, F.lit(1), position.cast("int"))
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def find_chunk(text: Column, chunk: Column, start: Column) -> Column:
    """0-based position of a chunk at or after start; before it only if the text holds it once; else null."""
    ahead = F.call_function("locate", chunk, text, (start + 1).cast("int"))
    times = F.try_divide(F.length(text) - F.length(F.replace(text, chunk, F.lit(""))), F.length(chunk))
    return F.when(ahead > 0, ahead - 1).when(times == 1, F.instr(text, chunk) - 1).cast("int")


def headings(text: Column) -> Column:
    """level and title of each markdown heading, in order."""
    lines = F.regexp_extract_all(text, F.lit(r"(?m)^(#{1,6}[ \t]+\S.*)$"), F.lit(1))
    return F.transform(
        lines, lambda x: F.struct(F.length(F.regexp_extract(x, "^(#+)", 1)).alias("level"), F.trim(F.regexp_replace(x, r"^#+\s+", "")).alias("title"))
    )


def heading_path(text: Column) -> Column:
    """Titles of the headings that are open at the end of the text: a heading closes those of its own and deeper levels."""
    none = F.array().cast("array<struct<level:int,title:string>>")
    opened = F.aggregate(headings(text), none, lambda acc, h: F.array_append(F.filter(acc, lambda x: x["level"] < h["level"]), h))
    return F.transform(opened, lambda x: x["title"])


def excerpts(text: Column, each: int = 1500, n: int = 3) -> Column:
    """Head, middle and tail of a long text; all of a short one; null for a null text."""
    middle = F.greatest(F.lit(each), F.floor(F.length(text) / 2).cast("int") - each // 2)
    parts = F.array(F.substring(text, 1, each), F.substring(text, middle + 1, F.lit(each)), F.substring(text, F.length(text) - each + 1, F.lit(each)))
    return F.when(F.length(text) <= n * each, F.array(text)).when(text.isNotNull(), parts)


def metadata_stub(file_name: Column, kind: Column, title: Column, subject: Column) -> Column:
    line = lambda label, value: F.concat(F.lit(f"{label}: "), value)
    return F.concat_ws("\n", line("File", file_name), line("Type", kind), F.when(title != file_name, line("Title", title)), F.when(subject != "", line("Subject", subject)))


def embedding_text(context: Column, content: Column) -> Column:
    return F.when(context != "", F.concat(context, F.lit("\n\n"), content)).otherwise(content)


def first_tokens(text: Column, most: int) -> Column:
    """The first words of a text, by the default tokenizer (white space)."""
    words = F.split(F.trim(text), r"\s+")
    return F.when(F.size(words) > most, F.array_join(F.slice(words, 1, most), " ")).otherwise(text)


def sentences(text: Column) -> Column:
    return F.split(text, r"(?<=[.!?])\s+")


def jaccard(a: Column, b: Column) -> Column:
    """Of the sets of lowercase words; 0 if either is empty."""
    words = lambda t: F.array_distinct(F.regexp_extract_all(F.lower(t), F.lit(r"(?U)\w+"), F.lit(0)))
    x, y = words(a), words(b)
    return F.when((F.size(x) > 0) & (F.size(y) > 0), F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))).otherwise(F.lit(0.0))


def date_bucket(at: Column, now: Column) -> Column:
    days = F.date_diff(F.to_date(now), F.to_date(at))
    return F.when(days <= 0, "Today").when(days == 1, "Yesterday").when(days <= 7, "Last 7 days").otherwise("Older")


def human_size(n: Column) -> Column:
    """Halves go to the even digit, as printf has them; null stays null."""
    scaled = lambda unit, name: F.concat(F.format_string("%.1f", F.bround(n / float(unit), 1)), F.lit(f" {name}"))
    return F.when(n.isNull(), None).when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024**2, scaled(1024, "KB")).when(n < 1024**3, scaled(1024**2, "MB")).otherwise(scaled(1024**3, "GB"))


def archive_path(uri: Column) -> Column:
    return F.regexp_replace(uri, "^/?archive/", "")


def is_encoded(name: Column) -> Column:
    return F.regexp_like(name, F.lit("%[0-9A-Fa-f]{2}"))


def escaped_heading(text: Column) -> Column:
    for c in "\\`*_[]#":
        text = F.replace(text, F.lit(c), F.lit("\\" + c))
    return text


#: Greetings that need no search.
GREETING = r"(?i)^\s*(hi|hello|hey|good (morning|afternoon|evening)|thanks|thank you|ok|okay|bye)\b[\s!.,?]*$"


def is_greeting(text: Column) -> Column:
    return F.regexp_like(text, F.lit(GREETING))


def listed(names: Column) -> Column:
    """`a`, `a and b`, or `a, b and 3 more`."""
    return (
        F.when(F.size(names) == 0, F.lit("")).when(F.size(names) == 1, names[0]).when(F.size(names) == 2, F.concat(names[0], F.lit(" and "), names[1]))
        .otherwise(F.concat(names[0], F.lit(", "), names[1], F.lit(" and "), (F.size(names) - 2).cast("string"), F.lit(" more")))
    )


#: Names of file kinds.
EXTENSIONS = {
    "PDF": "pdf", "DOCX": "docx", "PPTX": "pptx", "XLSX": "xlsx", "DOC": "doc", "PPT": "ppt", "XLS": "xls csv", "Text/Markdown": "txt md", "Images": "png jpg jpeg gif tiff tif bmp webp", "Other Docs": "rtf odt html htm",
}
MIME_FORMATS = {
    "application/pdf": "PDF", "image/png": "PNG", "image/x-png": "PNG", "image/jpeg": "JPEG", "image/jpg": "JPEG", "image/gif": "GIF", "image/webp": "WEBP", "image/tiff": "TIFF", "image/bmp": "BMP",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "DOCX", "application/vnd.openxmlformats-officedocument.presentationml.presentation": "PPTX",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "XLSX", "application/msword": "DOC", "application/vnd.ms-excel": "XLS", "application/vnd.ms-powerpoint": "PPT",
    "text/csv": "CSV", "application/rtf": "RTF", "text/rtf": "RTF", "text/html": "HTML", "application/zip": "ZIP", "application/x-zip-compressed": "ZIP",
}


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"[^./\\]\.([A-Za-z0-9]+)$", 1))


def file_category(name: Column) -> Column:
    ext, out = extension(name), F.lit("Other")
    for kind, known in EXTENSIONS.items():
        out = F.when(ext.isin(known.split()), kind).otherwise(out)
    return out


def mime_format(mime: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in MIME_FORMATS.items() for x in pair])
    return F.coalesce(F.element_at(known, mime), F.upper(F.element_at(F.split(mime, "/"), -1)))


def document_type(mime: Column) -> Column:
    """The attachment type of a MIME type, `attachment_other` for unknown ones."""
    kind = F.lower(mime_format(mime))
    kind = F.when(F.startswith(mime, F.lit("image/")), "image").otherwise(kind)
    known = "pdf image docx pptx xlsx doc xls ppt csv rtf".split()
    return F.concat(F.lit("attachment_"), F.when(kind.isin(known), kind).otherwise("other"))


def needs_heavy_parser(name: Column, mime: Column) -> Column:
    """Whether an attachment sends its e-mail to the slow lane: all but images do."""
    image = F.startswith(F.coalesce(mime, F.lit("")), F.lit("image/")) | (file_category(name) == "Images")
    zipped = F.contains(F.coalesce(mime, F.lit("")), F.lit("zip")) | (extension(name) == "zip")
    return zipped | ~image


def lane(attachments: Column) -> Column:
    """fast or slow, from array<struct<name, mime>>."""
    return F.when(F.exists(attachments, lambda a: needs_heavy_parser(a["name"], a["mime"])), "slow").otherwise("fast")


def is_meaningful_image(name: Column, size: Column, width: Column, height: Column) -> Column:
    """Not a logo, signature, tracking pixel or separator. Unknown sizes count as meaningful."""
    stem = F.regexp_replace(F.lower(name), r"\.[^.]*$", "")
    decorative = F.regexp_like(stem, F.lit("logo|banner|signature|icon"))
    inline = F.regexp_like(stem, F.lit(r"image\d{3}")) & F.coalesce(size < 100_000, F.lit(False))
    tiny = F.coalesce(size < 15_000, F.lit(False)) | F.coalesce(F.greatest(width, height) < 100, F.lit(False))
    strip = F.coalesce((height < 50) & (width > 3 * height), F.lit(False))
    return ~(decorative | inline | tiny | strip)


def parser_for(name: Column, mime: Column, by_mime: dict[str, str], by_extension: dict[str, str]) -> Column:
    """The registered parser of a file: by MIME type first, then by extension; null if none."""
    look = lambda table, key: F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key) if table else F.lit(None)
    return F.coalesce(look(by_mime, mime), look(by_extension, extension(name)))


def sentence_around(text: Column, position: Column) -> Column:
    """The sentence that holds a 0-based position, without citation markers; all of the text if none does."""

    def holding(parts: Column) -> Column:
        ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.length(F.array_join(F.slice(parts, F.lit(1), n), " ")))
        at = F.array_position(F.transform(ends, lambda e: e > position), F.lit(True))
        return F.when(at > 0, F.get(parts, (at - 1).cast("int"))).otherwise(text)

    found = F.transform(F.array(sentences(text)), holding)[0]
    return F.trim(F.regexp_replace(found, r"\[C:[a-f0-9]+\]", " "))


def addresses_in(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"), F.lit(0)), lambda a: F.lower(a)))


def iso_utc(text: Column) -> Column:
    """A timestamp from ISO 8601; without an offset it is UTC; null if it is none."""
    return F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00"))


def topic_input(subject: Column, body: Column, summary: Column, section: str = "Message:", longest: int = 3000, body_longest: int = 2000) -> Column:
    """What a topic extractor sees: the subject, the message section of the body, and the summary."""
    at = F.instr(body, F.lit(section))
    message = F.substring(F.when(at > 0, F.substring(body, at + len(section), F.length(body))).otherwise(body), 1, body_longest)
    line = lambda label, value: F.when(F.trim(value) != "", F.concat(F.lit(f"{label}: "), F.trim(value)))
    return F.substring(F.concat_ws("\n\n", line("Subject", subject), line("Message", message), line("Summary", summary)), 1, longest)


def _mended(text: str | None) -> str | None:
    """Tables of a markdown text with rows of one width and a delimiter row after the first."""
    if text is None or "|" not in text:
        return text
    out, block = [], []

    def flush() -> None:
        cells = [[c.strip() for c in line.strip().strip("|").split("|")] for line in block]
        rows = [c for c in cells if not all(set(x) <= set("-: ") and x for x in c)]
        if len(block) < 2 or not rows:
            out.extend(block)
        else:
            width = max(map(len, rows))
            lines = ["| " + " | ".join(c + [""] * (width - len(c))) + " |" for c in rows]
            out.extend([lines[0], "|" + "---|" * width, *lines[1:]])
        block.clear()

    for line in text.split("\n"):
        if line.lstrip().startswith("|"):
            block.append(line)
        else:
            flush()
            out.append(line)
    flush()
    return "\n".join(out)


@F.pandas_udf(StringType())
def mended_tables(text: pd.Series) -> pd.Series:
    return text.map(_mended)
