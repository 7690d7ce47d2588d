"""JVM-side text expressions that the operators share."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What separates words: space and the control characters from tab to carriage return.
NOT_SPACE = r"[\x20\x09-\x0D]+"


def static(method: str, *args: Column) -> Column:
    """A call of a public static method of a class that Spark ships with."""
    cls, name = method.rsplit(".", 1)
    return F.java_method(F.lit(cls), F.lit(name), *args)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A to Z only; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    # of ASCII, lower() changes nothing else, and it works on bytes
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, ascii_uppercase, ascii_lowercase))


def n_words(text: Column) -> Column:
    """How many maximal runs of non-space characters a text has; null has none."""
    text = F.coalesce(text, F.lit(""))
    pieces = F.size(F.split(text, NOT_SPACE)).cast("long")
    # split() yields an empty piece before leading and after trailing space
    edge = text.rlike(r"^[\x20\x09-\x0D]").cast("long") + text.rlike(r"[\x20\x09-\x0D]\z").cast("long")
    blank = text.rlike(r"^[\x20\x09-\x0D]*\z")
    return F.when(blank, F.lit(0).cast("long")).otherwise(pieces - edge)
