"""Tokenisation shared by the operators, as native expressions and for bytes."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Separators of words cut at white space: space and tab to carriage return.
SPACE = r"[\x20\x09-\x0D]+"
#: Separators of words of digits, a to z and characters beyond ASCII.
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def ascii_lower(text: Column) -> Column:
    """Lower-case A to Z only. ``lower`` does just that for texts wholly in ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def split_words(text: Column, separators: str = SPACE) -> Column:
    """Words of a text; no words for a null text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), separators), "")


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n
