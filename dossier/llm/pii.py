"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score [native].

All of it is built-in functions on one row: matches come from regexp_extract_all, the text between them from split with
the same pattern, and running sums of both lengths give positions in code points. No shuffle.

Kinds email, ip, card (Luhn) and phone always count once their own check passes. Kinds iban (mod-97), ssn and
local_phone are added where no span of those overlaps and the score (a start value, more for a passed checksum, more
for context words nearby) reaches KEEP.

Patterns hold possessive quantifiers and, where a run of one class starts a match, a look-behind: the same matches as the
plain forms, in time linear in the text and without deep recursion on long runs.

Defined cases: a null text is an empty one; an empty text has no spans; texts are searched whole, whatever their length; spans that
start together are in the order of their kinds; repeated rows are rows of their own; extra columns are kept in `row`, whatever their names;
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.llm.common import prefix_sums, running

#: Kind -> pattern, in the order in which kinds sort.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "local_phone": r"(?<![0-9+])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
}
BASE = ("email", "ip", "card", "phone")
#: What must be in a text for a pattern to be tried at all.
NEEDS = {"email": "@", "phone": "+"}
#: Kind -> (score at first, score of a passed checksum, context words, score of a context word nearby).
SCORES = {
    "email": (0.9, 0.0, r"mail|contact|write|schreib|correo", 0.1),
    "ip": (0.6, 0.0, r"\bip\b|host|server|address|adresse", 0.3),
    "card": (0.4, 0.4, r"card|karte|carte|tarjeta|visa|master|pay", 0.2),
    "phone": (0.6, 0.0, r"phone|call|tel|mobile|fax|t[eé]l[eé]f", 0.3),
    "iban": (0.2, 0.6, r"iban|konto|account|compte|cuenta|bank", 0.2),
    "ssn": (0.3, 0.0, r"\bssn\b|social security|sozialversicherung", 0.5),
    "local_phone": (0.3, 0.0, r"phone|call|tel|mobile|fax|t[eé]l[eé]f", 0.5),
}
KEEP = 0.7
BEFORE, AFTER = 48, 24  # code points of context


def luhn(digits: Column) -> Column:
    def add(acc: Column, i: Column) -> Column:
        d = F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 1, d).when(d < 5, d * 2).otherwise(d * 2 - 9)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def mod97(iban: Column) -> Column:
    """The first four characters move to the end, letters count 10 to 35, and the number's remainder is 1."""
    plain = F.replace(iban, F.lit(" "), F.lit(""))
    moved = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))

    def add(acc: Column, i: Column) -> Column:
        c = F.substring(moved, i, F.lit(1))
        return F.when(c.between("0", "9"), acc * 10 + c.cast("int")).otherwise(acc * 100 + F.ascii(c) - 55) % 97

    return F.length(plain).between(15, 34) & (F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), add) == 1)


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.regexp_like(p, F.lit("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")))
    if kind == "card":
        digits = F.regexp_replace(value, "[ -]", "")
        return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(F.regexp_replace(value, "[^0-9]", "")).between(9, 15)
    if kind == "iban":
        return mod97(value)
    if kind == "ssn":
        return ~F.regexp_like(value, F.lit("^(?:000|666|9)|-00-|-0000$"))
    return F.lit(True)


def detect(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs as `row` (a struct of all its columns) and `spans`: array of start, kind_no, end, kind, score, by start and kind.

    Positions count code points from 0; end is exclusive.
    """
    df = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    none = F.array().cast("array<string>")

    def tried(kind: str, found: Column) -> Column:
        able = F.contains(F.col("text"), F.lit(NEEDS[kind])) if kind in NEEDS else F.regexp_like("text", F.lit("[0-9]"))
        return F.when(able, found).otherwise(none)

    df = df.withColumns({f"m_{k}": tried(k, F.regexp_extract_all("text", F.lit(p), F.lit(0))) for k, p in PATTERNS.items()})
    gaps = {k: F.when(F.size(f"m_{k}") > 0, F.transform(F.split("text", p, -1), lambda g: F.length(g).cast("bigint"))).otherwise(F.array().cast("array<bigint>")) for k, p in PATTERNS.items()}
    df = df.withColumns({f"g_{k}": g for k, g in gaps.items()})
    df = df.withColumns(
        {f"p_{k}": prefix_sums(F.zip_with(f"m_{k}", F.slice(f"g_{k}", F.lit(1), F.size(f"m_{k}")), lambda m, g: F.length(m) + g)) for k in PATTERNS}
    )

    def spans(kind: str, no: int) -> Column:
        first, check, words, near = SCORES[kind]

        def span(m: Column, i: Column) -> Column:
            start = F.get(F.col(f"p_{kind}"), i) + F.get(F.col(f"g_{kind}"), i)
            return F.struct(start.alias("start"), F.lit(no).alias("kind_no"), (start + F.length(m)).alias("end"), F.lit(kind).alias("kind"), m.alias("value"))

        def scored(s: Column) -> Column:
            begin = F.greatest(s["start"] - BEFORE, F.lit(0))
            around = F.substring(F.col("text"), (begin + 1).cast("int"), (s["end"] + AFTER - begin).cast("int"))
            score = F.lit(first + check) + F.when(F.regexp_like(F.lower(around), F.lit(words)), F.lit(near)).otherwise(0.0)
            return F.struct(s["start"].alias("start"), s["kind_no"].alias("kind_no"), s["end"].alias("end"), s["kind"].alias("kind"), F.least(score, F.lit(1.0)).alias("score"))

        return F.transform(F.filter(F.transform(f"m_{kind}", span), lambda s: valid(kind, s["value"])), scored)

    numbered = {k: i for i, k in enumerate(PATTERNS)}
    df = df.select("row", "text", *[spans(k, numbered[k]).alias(f"s_{k}") for k in PATTERNS])
    df = df.select("row", "text", F.concat(*[F.col(f"s_{k}") for k in BASE]).alias("base"), F.concat(*[F.col(f"s_{k}") for k in PATTERNS if k not in BASE]).alias("more"))
    free = lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    more = F.filter("more", lambda s: (s["score"] >= KEEP) & free(s))
    return df.select("row", "text", F.sort_array(F.concat("base", more)).alias("spans"))


def ends_reached(spans: Column) -> Column:
    """Before each span the furthest end of those before it, and last that of all."""
    return running(F.transform(spans, lambda s: s["end"]), lambda a, x: F.greatest(a, x))


def redact(text: Column, spans: Column, reached: Column) -> Column:
    """The text with every span replaced by its kind in brackets; overlapping spans become one gap, named by the first.

    reached: a column of ends_reached(spans), as every span uses it.
    """

    def piece(s: Column, i: Column) -> Column:
        from_ = F.get(reached, i)
        kept = F.substring(text, (from_ + 1).cast("int"), F.greatest(s["start"] - from_, F.lit(0)).cast("int"))
        return F.concat(kept, F.when(s["start"] >= from_, F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(F.lit("")))

    tail = F.substring(text, (F.element_at(reached, -1) + 1).cast("int"), F.length(text))
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(F.array_join(F.transform(spans, piece), ""), tail))


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs, all columns and rows, with personal data in text_col replaced. A null text stays null."""
    found = detect(docs, text_col).withColumn("reached", ends_reached(F.col("spans")))
    text = F.when(F.col("row")[text_col].isNotNull(), redact(F.col("text"), F.col("spans"), F.col("reached")))
    return found.select("row", text.alias("clean")).select(F.col("row").withField(f"`{text_col}`", F.col("clean")).alias("row")).select("row.*")


def digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
