"""E-mail bodies: split a thread into messages, remove boilerplate, join what remains."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dossier.functions.text import stripped

#: What opens a quoted message.
BOUNDARIES = (
    r"On\s+\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2},\s+[^\n]+\s+wrote:",
    r"On\s+[A-Za-z]{3}\s+\d{1,2},\s+\d{4},?\s+(?:at\s+)?[\d:]+\s*(?:AM|PM)?,\s+[^\n]+\s+wrote:",
    r"From:\s+[^\n]+\nSent:\s+[^\n]+\nTo:\s+[^\n]+\n(?:Cc:\s+[^\n]+\n)?Subject:\s+[^\n]+",
    r"-{3,}\s*Original Message\s*-{3,}",
)
#: Boilerplate, in the order in which it is removed. The disclaimer's last repetition is possessive, as each line it takes
#: would be a level of recursion otherwise.
BOILERPLATE = (
    r"<mailto:[^>]+>",
    r"\[cid:[^\]]+\]",
    r"\[\s*[Xx]?\s*\]",
    r"(?m)^[_\-]{6,}\s*$",
    r"(?m)^E-Mail:\s*[^\n]+$",
    r"(?m)^[TME]:\s*\+?[\d\s\-\.]+$",
    r"(?m)^[TME]:\s*\S+@\S+$",
    r"(?mi)^(?:INM\s+FBB|VSAT|FAX)[\s\d:]+[\d\s\-\.]+$",
    r"(?m)^\d+[-\d]*\s+[A-Za-z\s]+(?:Street|Road|Ave|Avenue|Blvd),?\s*\d*,?\s*[A-Za-z\s]+,?\s*[A-Za-z\s]*$",
    r"(?m)^(?:Date|From|To|Att|Cc|Subject|Sent):\s*[^\n]+$",
    r"(?mi)^IMPORTANT:\s*Please always use[^\n]+$",
    r"(?mi)^Please send all invoices[^\n]+$",
    r"(?mi)^(?:Please\s+)?(?:find|see)\s+(?:the\s+)?(?:attached|enclosed|herewith)\s*\.?\s*$",
    r"(?mi)^(?:DISCLAIMER|CONFIDENTIAL(?:ITY)?[\s:]|This (?:e-?mail|message|communication) (?:and any|is|may)[^\n]*(?:confidential|privileged|intended))[^\n]*(?:\n(?![\n])[^\n]*)*+",
    r"(?mi)^(?:Unsubscribe|Click here to (?:unsubscribe|opt[- ]out))[^\n]*$",
    r"(?m)^(?:Best [Rr]egards|Kind [Rr]egards|Regards|Warm [Rr]egards)\s*,?\s*$",
)
_MARK = "\u0000"  # stands between messages; bodies hold no NUL


def messages(body: Column) -> Column:
    """array of messages, newest first; each but the first begins with the line that quotes it. The body itself if none."""
    marked = F.regexp_replace(F.replace(body, F.lit(_MARK), F.lit("")), "(?im)(" + "|".join(BOUNDARIES) + ")", _MARK + "$1")
    parts = F.filter(F.transform(F.split(marked, _MARK), stripped), lambda x: x != "")
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(body))


def without_boilerplate(message: Column) -> Column:
    for pattern in BOILERPLATE:
        message = F.regexp_replace(message, pattern, "")
    return stripped(F.regexp_replace(message, r"\n{3,}", "\n\n"))


def clean_body(body: Column) -> Column:
    """A thread's text without boilerplate, messages apart by an empty line. Blank bodies stay as they are."""
    kept = F.filter(F.transform(messages(body), without_boilerplate), lambda x: x != "")
    joined = stripped(F.regexp_replace(F.array_join(kept, "\n\n"), r"\n{3,}", "\n\n"))
    return F.when(F.regexp_like(body, F.lit(r"\S")), joined).otherwise(body)


def quoted_header(message: Column) -> Column:
    """struct(sender, sent, recipients, subject) of a quoted message's header lines; null where absent."""
    field = lambda name: F.nullif(F.trim(F.regexp_extract(message, rf"(?mi)^{name}:[ \t]*(.+)$", 1)), F.lit(""))
    wrote = F.nullif(F.regexp_extract(message, r"(?is)^On\s.+?,\s+([^,\n]+?)\s+wrote:", 1), F.lit(""))
    return F.struct(F.coalesce(field("From"), wrote).alias("sender"), F.coalesce(field("Sent"), field("Date")).alias("sent"), field("To").alias("recipients"), field("Subject").alias("subject"))


def unquoted(message: Column) -> Column:
    """Without the > marks of quoted lines."""
    return F.regexp_replace(message, r"(?m)^(?:>[ \t]?)+", "")
