"""Text expressions: folding, bracketed glosses, placeholders. Built-in functions only."""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters of other scripts that look like a Latin one, and those.
LOOKALIKES = ("аеіјорсухѕԁһԛѡάαεικνορτυχ", "aeijopcyxsdhqwaaeikvoptux")


@functools.cache
def _accents() -> tuple[str, str]:
    """Lower-case characters that decompose to one ASCII character and marks, and those characters."""
    pairs = []
    for start, end in ((0xA1, 0x250), (0x1E00, 0x1F00), (0x2100, 0x2140), (0xFF01, 0xFF5F)):
        for code in range(start, end):
            base = [c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c)]
            if len(base) == 1 and base[0].isascii():
                pairs.append((chr(code), base[0].lower()))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def folded(c: Column) -> Column:
    """Lower case, without accents, marks and invisible characters, look-alike letters as Latin ones, white space as single spaces."""
    c = F.translate(F.translate(F.lower(c), *_accents()), *LOOKALIKES)
    c = F.regexp_replace(c, r"[\p{M}\p{Cf}]+", "")
    return F.trim(F.regexp_replace(c, r"[\s\p{Z}]+", " "))


def words(c: Column) -> Column:
    """The runs of letters and digits."""
    return F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def token(c: Column) -> Column:
    """A typed name as a token: brackets removed, lower case, hyphens and white space as single spaces."""
    c = F.regexp_replace(c, r"\([^)]*\)", "")
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), "-", " "), r"[\s\p{Z}]+", " "))


def gloss(c: Column) -> Column:
    """The text in the first round brackets as a token, null if there is none."""
    found = token(F.regexp_extract(c, r"\(([^)]*)\)", 1))
    return F.when(found != "", found)


def any_word(c: Column, pattern_words: Column) -> Column:
    """Whether one of the words, already escaped and joined by |, stands in c as a whole word, in any case."""
    return F.regexp_like(c, F.concat(F.lit(r"(?i)\b("), pattern_words, F.lit(r")\b")))
