"""Numbers in table cells, by two readings: what looks numeric, and what can be summed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def _to_double(text: Column) -> Column:
    named = F.lower(text).rlike(r"^[+-]?(nan|inf|infinity)$")
    return F.when(text.rlike(NUMBER) | named, text.try_cast("double"))


def _signed(text: Column) -> Column:
    """(x) means -x."""
    return F.when(text.startswith("(") & text.endswith(")") & (F.length(text) >= 2), F.concat(F.lit("-"), text.substr(F.lit(2), F.length(text) - 2))).otherwise(text)


def numeric_like(cell: Column) -> Column:
    """True if the cell is a number once separators, currency and percent signs are gone; these go before parentheses are read."""
    return _to_double(_signed(F.regexp_replace(F.trim(cell), r"[,$%]", ""))).isNotNull()


def number_in(cell: Column) -> Column:
    """The number in a cell, else null. Parentheses are read before signs and inner blanks go."""
    return _to_double(F.regexp_replace(_signed(F.trim(cell)), r"[$,%\s]", ""))
