"""The shape of a document's content, and the rules that say how it is embedded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Thresholds of the rules.
SHORT_TOKENS, BULK_TOKENS, MEDIUM_TOKENS = 50, 20_000, 50_000
NO_PROSE, DIGITS, TABLE, REPETITION, SHORT_LINES, MEDIUM_PROSE = 0.15, 0.40, 0.50, 0.92, 0.95, 0.50
SIGNALS = ("total_chars", "total_tokens", "digit_ratio", "table_char_pct", "repetition_score", "unique_token_ratio", "prose_ratio", "heading_count", "short_line_ratio")


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


#: White space and line starts of lines and headings, as SQL has them: no vertical tab, and lines end at line feeds alone. Trimmed are all spaces (Zs).
GAP, SOLID, HEADING, OUTER = r"[\t\n\f\r ]+", r"[^\t\n\f\r ]", r"(?md)^#{1,6}[\t\n\f\r ]+[^\t\n\f\r ]", r"^\p{Zs}+|\p{Zs}+\z"


def with_shape(docs: DataFrame, text: str = "text", tokens: Column | None = None) -> DataFrame:
    """Adds SIGNALS. tokens: array column of a tokenizer; by default words and single punctuation marks."""
    t = F.coalesce(F.col(text), F.lit(""))
    tokens = tokens if tokens is not None else F.regexp_extract_all(t, F.lit(r"(?U)\w+|[^\w\s]"), F.lit(0))
    lines = F.filter(F.split(t, "\n"), lambda x: F.regexp_like(x, F.lit(SOLID)))
    df = docs.withColumns({"_lines": lines, "_tokens": tokens, "_solid": F.regexp_count(t, F.lit(r"(?U)\S"))})
    n = F.greatest(F.size("_lines"), F.lit(1))
    return df.withColumns(
        {
            "total_chars": F.length(t), "total_tokens": F.size("_tokens"),
            "digit_ratio": _ratio(F.regexp_count(t, F.lit(r"\p{Nd}")), F.col("_solid")),
            "table_char_pct": _ratio(F.size(F.filter("_lines", lambda x: F.regexp_like(x, F.lit(r"^\p{Zs}*\|")))), n),
            "repetition_score": F.when(F.length(t) > 0, 1.0 - _ratio(F.size(F.array_distinct("_lines")), n)).otherwise(F.lit(0.0)),
            "unique_token_ratio": _ratio(F.size(F.array_distinct("_tokens")), F.size("_tokens")),
            "prose_ratio": _ratio(F.regexp_count(t, F.lit(r"\p{L}")), F.col("_solid")),
            "heading_count": F.regexp_count(t, F.lit(HEADING)),
            "short_line_ratio": _ratio(F.size(F.filter("_lines", lambda x: F.size(F.split(F.regexp_replace(x, OUTER, ""), GAP)) <= 3)), n),
        }
    ).drop("_lines", "_tokens", "_solid")


def embedding_mode(peek_pages: Column | None = None, total_pages: Column | None = None, triage: Column | None = None) -> Column:
    """struct(mode, reason) from SIGNALS. triage: mode for documents that need a model's word; by default a summary.

    The token count of a peek of the first pages is extrapolated to all pages.
    """
    tokens = F.col("total_tokens")
    if peek_pages is not None and total_pages is not None:
        tokens = F.when(total_pages > peek_pages, F.floor(tokens * total_pages / peek_pages)).otherwise(tokens)
    bulk = tokens > BULK_TOKENS
    out = lambda mode, reason: F.struct(F.lit(mode).alias("mode"), F.lit(reason).alias("reason"))
    asked = F.struct(triage.alias("mode"), F.lit("triage").alias("reason")) if triage is not None else out("summary", "triage_dense")
    return (
        F.when((F.col("total_chars") < SHORT_TOKENS * 4) | (F.col("total_tokens") < SHORT_TOKENS), out("metadata_only", "too_short"))
        .when((F.col("prose_ratio") < NO_PROSE) & (F.col("heading_count") == 0), out("metadata_only", "no_prose"))
        .when(bulk & (F.col("digit_ratio") > DIGITS), out("summary", "bulk_numeric"))
        .when(bulk & (F.col("table_char_pct") > TABLE), out("summary", "tabular"))
        .when(bulk & (F.col("repetition_score") > REPETITION), out("summary", "repetitive"))
        .when(bulk & (F.col("short_line_ratio") > SHORT_LINES), out("summary", "short_lines"))
        .when((tokens > MEDIUM_TOKENS) & (F.col("prose_ratio") < MEDIUM_PROSE), asked)
        .otherwise(out("full", "default_prose"))
    )


def with_utility(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the seven measures of how useful a text is for retrieval, and struct utility(class, reason)."""
    t = F.coalesce(F.col(text), F.lit(""))
    marks = F.regexp_count(t, F.lit(r"[.,:;+-]"))
    lines = F.filter(F.split(t, r"\r\n|[\n\r]"), lambda x: F.regexp_like(x, F.lit(r"\S")))
    df = docs.withColumns({"_words": F.transform(F.regexp_extract_all(t, F.lit(r"[A-Za-z][A-Za-z'-]*"), F.lit(0)), lambda w: F.lower(w)), "_lines": lines})
    n, words = F.size("_lines"), F.size("_words")
    df = df.withColumns(
        {
            "char_count": F.length(t), "word_count": words, "unique_word_ratio": _ratio(F.size(F.array_distinct("_words")), words),
            "numeric_char_ratio": _ratio(F.regexp_count(t, F.lit(r"\p{Nd}")) + marks, F.regexp_count(t, F.lit(r"[\p{L}\p{N}]")) + marks),
            "avg_line_length": _ratio(F.aggregate(F.transform("_lines", lambda x: F.length(x)), F.lit(0), lambda a, x: a + x), n),
            "short_line_ratio": _ratio(F.size(F.filter("_lines", lambda x: F.size(F.split(F.trim(x), r"\s+")) < 5)), n),
            "avg_sentence_words": _ratio(words, F.size(F.filter(F.split(t, r"[.!?]+\s+"), lambda x: F.regexp_like(x, F.lit(r"\S"))))),
        }
    ).drop("_words", "_lines")
    out = lambda kind, reason: F.struct(F.lit(kind).alias("class"), F.lit(reason).alias("reason"))
    return df.withColumn(
        "utility",
        F.when(F.col("word_count") < 100, out("skip", "almost_no_text"))
        .when((F.col("numeric_char_ratio") > 0.55) & (F.col("unique_word_ratio") < 0.08), out("skip", "numeric_heavy_repetitive"))
        .when((F.col("short_line_ratio") > 0.85) & (F.col("avg_line_length") < 30), out("summary_only", "mostly_short_lines"))
        .when(F.col("unique_word_ratio") < 0.03, out("skip", "extreme_repetition"))
        .when((F.col("unique_word_ratio") > 0.15) & (F.col("avg_sentence_words") > 8), out("keep", "narrative_rich"))
        .otherwise(out(None, "needs_review")),
    )
