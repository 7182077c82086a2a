"""Text scalars as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that is stripped at line ends: blanks of Unicode, but no line feed.
BLANK = r"[ \t\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def normalize(text: Column) -> Column:
    """Line ends to LF, control characters out, runs of blanks to one space, lines stripped; null to ''."""
    out = F.coalesce(text, F.lit(""))
    for pattern, by in ((r"\r\n?", "\n"), (r"[\x00-\x08\x0b-\x1f]", ""), (r"[ \t]+", " "), (rf"(^|\n){BLANK}", "$1"), (rf"{BLANK}(\n|\z)", "$1")):
        out = F.regexp_replace(out, pattern, by)
    return out


def strip(text: Column) -> Column:
    """As Python's str.strip()."""
    edge = BLANK.replace("[ ", r"[ \n\r\x0b\x0c\x1c-\x1f")
    return F.regexp_replace(text, rf"^{edge}|{edge}\z", "")


def word_count(text: Column) -> Column:
    """Runs of what is no white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0))


def text_length(text: Column) -> Column:
    return F.length(strip(F.coalesce(text, F.lit(""))))


def density(length: Column, width: Column, height: Column) -> Column:
    """Characters for each unit of page area; 0 for a page without area."""
    area = width * height
    return F.when(area > 0, length / area).otherwise(0.0)


def join_tokens(tokens: Column) -> Column:
    """Tokens that are not blank, joined by one space."""
    return F.trim(F.array_join(F.filter(tokens, lambda t: F.trim(t) != ""), " "))


def checksum(content: Column) -> Column:
    return F.sha2(content, 256)


def is_checksum(text: Column) -> Column:
    return F.coalesce(F.lower(text).rlike("^[a-f0-9]{64}$"), F.lit(False))


def is_uuid(text: Column) -> Column:
    return F.coalesce(F.lower(text).rlike("^[0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12}$"), F.lit(False))
