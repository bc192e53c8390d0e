"""Tokens, stems, headings, sentences, paragraphs and set similarity as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The word pattern, and the suffixes in the order in which the first fitting one is taken.
WORD = "([A-Za-zА-Яа-яЁё0-9]+)"
EN_SUFFIXES = ["ing", "ed", "ly", "es", "s", "er", "or", "al", "ive", "tion", "ions", "ment", "ments"]
RU_SUFFIXES = ["ими", "ами", "ями", "иях", "ого", "ему", "ому", "ыми", "ям", "ев", "ов", "ие", "ые", "ая", "яя", "ое", "ее", "ий", "ый", "ой", "ем", "им", "ах", "ях", "ом", "ам", "ю", "е", "а", "ы", "и", "о", "у", "я"]
SENTENCE_END = r"(?U)(?<=[.!?…])\s+"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def tokens(c: Column) -> Column:
    """A1: words, case kept."""
    return F.regexp_extract_all(c, F.lit(WORD), F.lit(1))


def tokens_legacy(c: Column) -> Column:
    """A2: lower-cased words, underscore included."""
    return F.regexp_extract_all(F.lower(c), F.lit("([A-Za-zА-Яа-яЁё0-9_]+)"), F.lit(1))


def stem(token: Column) -> Column:
    """A3: the first suffix of the list that leaves three characters goes; it is not the longest one."""
    t = F.lower(token)

    def cut(suffixes: list[str]) -> Column:
        fits = F.filter(F.array(*map(F.lit, suffixes)), lambda s: F.endswith(t, s) & (F.length(t) - F.length(s) >= 3))
        return F.coalesce(F.left(t, F.length(t) - F.length(F.get(fits, F.lit(0)))), t)

    return F.when(t.rlike("^[a-z]"), cut(EN_SUFFIXES)).otherwise(cut(RU_SUFFIXES))


def analyzed(c: Column) -> Column:
    """A4: stems of all words in order."""
    return F.transform(tokens(c), stem)


def count_of(c: Column, pattern: str) -> Column:
    """Characters of c in a character class."""
    return F.length(c) - F.length(F.regexp_replace(c, pattern, ""))


def heading(c: Column) -> Column:
    """A5: the first line if it looks like a heading, else empty."""
    first = strip(F.substring_index(strip(c), "\n", 1))
    upper = count_of(first, r"\p{Lu}")
    fits = (F.length(first) <= 120) & (upper >= F.greatest(F.lit(1), F.floor(F.length(first) / 5)))
    return F.when(fits | F.startswith(first, F.lit("#")), first).otherwise(F.lit(""))


def sentences(c: Column) -> Column:
    """Sentences, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(c, SENTENCE_END), strip), lambda s: s != "")


def paragraphs(c: Column) -> Column:
    """A10: blocks between blank lines, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(c, r"(?U)\n\s*\n"), strip), lambda s: s != "")


def is_heading_block(c: Column) -> Column:
    """A short block that begins like a section or is mostly upper case."""
    letters = count_of(c, r"\p{L}")
    return (F.length(c) <= 120) & (c.rlike(r"(?iu)^\s*(раздел|глава|статья|section|chapter)\b|^\s*\d+(\.\d+)*[.)]?\s+\S|^#") | ((letters > 0) & (count_of(c, r"\p{Lu}") >= 0.7 * letters)))


def is_bullet_block(c: Column) -> Column:
    """Every line of the block is a list item."""
    return F.forall(F.split(c, "\n"), lambda s: s.rlike(r"^\s*([-*•–—]|\d+[.)])\s+"))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays as sets; 0 if either is empty."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def word_set(c: Column) -> Column:
    """Distinct lower-case words between white space."""
    return F.array_distinct(F.filter(F.split(F.lower(c), r"(?U)\s+"), lambda w: w != ""))
