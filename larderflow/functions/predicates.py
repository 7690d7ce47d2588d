"""Predicates on lines of text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from larderflow import config as C
from larderflow.functions.text import strip, strip_chars, words

FRACTION_CLASS = "".join(C.FRACTIONS)
LEADING_QUANTITY = rf"(?iU)^\s*(\d|[{FRACTION_CLASS}]|({'|'.join(map(re.escape, C.NUMBER_WORDS))})\b)"


def is_temperature(text: Column) -> Column:
    return text.rlike(f"(?iU){C.TEMPERATURE}")


def is_noise(text: Column) -> Column:
    """A noise phrase anywhere, a temperature, or a noise word among the tokens; never for blank text."""
    low = strip(F.lower(text))
    phrase = low.rlike("|".join(map(re.escape, C.NOISE_PHRASES)))
    tokens = F.transform(words(low), lambda w: strip_chars(w, ",.:;!?"))
    return (low != "") & (phrase | is_temperature(low) | F.arrays_overlap(tokens, F.array(*map(F.lit, C.NOISE_WORDS))))


def is_heading(line: Column) -> Column:
    return line.rlike(C.HEADING)


def is_next_section(line: Column) -> Column:
    return line.rlike(C.NEXT_SECTION)


def strip_bullet(line: Column) -> Column:
    """One bullet less at the start, and no white space around what is left."""
    return strip(F.regexp_replace(line, r"(?U)^\s*[-*•]\s*", ""))


def is_candidate(line: Column) -> Column:
    """No verb among the first two tokens, and a leading quantity or a unit among the first four."""
    tokens = words(line)
    lead = F.transform(F.slice(tokens, 1, 2), lambda w: F.lower(strip_chars(w, ":.,")))
    near = F.transform(F.slice(tokens, 1, 4), lambda w: F.lower(strip_chars(w, ",.:;")))
    verbs, units = F.array(*map(F.lit, C.VERBS)), F.array(*map(F.lit, sorted({u.lower() for u in C.UNIT_WORDS})))
    return (F.size(tokens) > 0) & ~F.arrays_overlap(lead, verbs) & (line.rlike(LEADING_QUANTITY) | F.arrays_overlap(near, units))


def excluded(key: Column, cfg: C.Config = C.DEFAULT) -> Column:
    return key.isin(*cfg.excluded)


def known_aisle(category: Column, cfg: C.Config = C.DEFAULT) -> Column:
    return F.coalesce(category.isin(*cfg.aisles), F.lit(False))
