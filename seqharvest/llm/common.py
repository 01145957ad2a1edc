"""What the text operators share: words, row keys, code for executors."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import Column, functions as F

#: Java pattern of what separates words.  Upper-case letters count as letters here, so that a text need not be lower-cased before it is split.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: UTF-8 bytes of a text -> lower-case word bytes with spaces between; bytes over 127 belong to words.
WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32
    for c in range(256)
)


def ship(module: str) -> None:
    """Send a module's functions to executors by value: they need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def words(text: str | None) -> list[bytes]:
    """Words of a text, A-Z lower-cased, as UTF-8."""
    return (text or "").encode("utf-8", "replace").translate(WORD_BYTES).split()


def word_array(text: Column) -> Column:
    """Words of a text as an array (native); letters keep their case."""
    return F.filter(F.split(text, SEPARATORS), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def free_name(taken: list[str], want: str) -> str:
    """A column name like ``want`` that is not taken (Spark compares without case)."""
    used = {c.lower() for c in taken}
    while want.lower() in used:
        want = "_" + want
    return want


ship(__name__)
