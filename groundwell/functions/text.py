"""Text expressions shared by the operators."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Unicode White_Space code points.
WHITESPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    """Removes white space, Unicode included, at both ends (Spark's trim takes only blanks)."""
    return F.btrim(text, F.lit(WHITESPACE))


def is_blank(text: Column) -> Column:
    return text.isNull() | (strip(text) == "")


def blank_to_null(text: Column) -> Column:
    return F.nullif(strip(text), F.lit(""))


def first_failure(*rules: tuple[str, Column]) -> Column:
    """The code of the first rule whose condition holds, null when a row passes all."""
    (code, failed), *rest = rules
    return reduce(lambda chain, rule: chain.when(rule[1], rule[0]), rest, F.when(failed, code))


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units: code points beyond U+FFFF count twice."""
    return F.length(text) + F.length(F.regexp_replace(text, r"[^\x{10000}-\x{10FFFF}]", ""))


def file_extension(name: Column) -> Column:
    return F.regexp_extract(name, r"(\.[^.]*)$", 1)


def file_stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def allowed_extension(name: Column, allowed) -> Column:
    """True where the extension, in any case, is one of `allowed` (leading dot optional)."""
    dotted = [("" if e.startswith(".") else ".") + e for e in allowed]
    return F.lower(file_extension(name)).isin([e.lower() for e in dotted])
