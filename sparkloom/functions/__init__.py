"""Column functions over texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = "[A-Za-z0-9]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: RFC 5322's atoms, joined by dots (without the quotes ' and `), and RFC 1034's labels, the last of letters.
ATOM = "[A-Za-z0-9!#$%&*+/=?^_{|}~-]+"
LABEL = "[A-Za-z0-9]+(-+[A-Za-z0-9]+)*"
EMAIL = f"{ATOM}([.]{ATOM})*@({LABEL}[.])+[A-Za-z]{{2,}}"


def tokens(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits, repeats kept; a null text has none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(TOKEN), F.lit(0))


def count_of(items: Column, wanted: str) -> Column:
    return F.size(F.filter(items, lambda x: x == wanted))


def collapsed(text: Column) -> Column:
    """ASCII white space runs as one space, trimmed."""
    return F.trim(F.regexp_replace(text, "[ \\t\\n\\x0B\\f\\r]+", " "))


def excerpt(text: Column, limit: int) -> Column:
    """Collapsed text of at most limit characters, marked if it was cut."""
    whole = collapsed(text)
    return F.when(F.length(whole) <= limit, whole).otherwise(F.concat(F.rtrim(F.substring(whole, 1, limit - 1)), F.lit("…")))
