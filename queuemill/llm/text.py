"""Small column helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, also where ``body`` uses it in a loop."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; pure ASCII texts take the short way."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def white_words(text: Column) -> Column:
    """Runs of characters other than ASCII white space, in order; no words for NULL."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WHITE), "")


def text_key(text: Column) -> Column:
    """Tells rows with one id but different texts apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")), text.isNull())
