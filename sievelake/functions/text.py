"""Normalisation, hashes, character n-grams, set likeness and word functions, all as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What separates words in Python's sense; the four ASCII separators are not in Java's class.
SPACE = r"(?U)[\s\x1C-\x1F]+"
#: The same characters one by one, inside a class: as fast as a class can be.
BLANKS = r"\t-\r\x1c-\x1f \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Inside a class: letters, digits and the underscore; the signs of most texts stand one by one, so that a bit table answers for them.
WORDLY = r"_abcdefghijklmnopqrstuvwxyz0123456789\p{L}\p{N}"
# The signs stripped from both ends of a word.
EDGE_SIGNS = ".,;:!?()\"'«»፡።፣፤፥፦፧"
CONTEXT_MARK = "\n\nContext:\n"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row, however often ``body`` names it inside its own lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    """Without white space at the ends, in the Unicode sense (``trim`` takes blanks alone)."""
    return F.regexp_replace(c, r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$", "")


def clean_spaces(c: Column) -> Column:
    """Runs of two or more blanks, tabs or no-break spaces become one blank."""
    return F.regexp_replace(c, "[ \\t\\u00a0]{2,}", " ")


def composed_and_folded(c: Column) -> Column:
    """Unicode form C, then full case folding (ß as ss, ς as σ): the ICU library that Spark brings, called in the JVM."""
    text = F.coalesce(c, F.lit(""))
    composed = F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(False))
    return F.when(c.isNotNull(), F.java_method(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), composed, F.lit(True)))


def norm(c: Column) -> Column:
    """Folded text: composed, case-folded, and of the rest letters, digits, underscores and single blanks alone.

    Not to stand inside an aggregate function: Spark takes calls into a library for nondeterministic.
    """
    kept = F.regexp_replace(composed_and_folded(c), rf"[^ {WORDLY}{BLANKS}]+", "")
    # What isn't of a word now is blank; single blanks stay as they are.
    return F.trim(F.regexp_replace(kept, rf" [^{WORDLY}]+|[^ {WORDLY}][^{WORDLY}]*", " "))


def sha(n: Column) -> Column:
    """SHA-256 of a folded text without its blanks."""
    return F.sha2(F.replace(n, F.lit(" "), F.lit("")), 256)


def grams(n: Column, size: int = 4) -> Column:
    """Distinct character n-grams of a folded text, blanks included; a shorter text is its own single gram.

    Each match looks ahead and takes one whole character, so none begins inside a character of two units.
    """
    found = F.array_distinct(F.regexp_extract_all(n, F.lit(f"(?s)(?=(.{{{size}}}))."), F.lit(1)))
    return F.when(F.char_length(n) < size, F.array(n)).otherwise(found)


def grams_unspaced(n: Column, size: int = 4) -> Column:
    """The same without blanks."""
    return grams(F.replace(n, F.lit(" "), F.lit("")), size)


def jaccard(a: Column, b: Column) -> Column:
    """Likeness of two sets of distinct members; 0 if one is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def contain(a: Column, b: Column) -> Column:
    """Share of ``a`` that is in ``b``, too; 0 if ``a`` is empty."""
    return F.when(F.size(a) == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def words(c: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(c, SPACE), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(words(c))


def bare_words(c: Column) -> Column:
    """Words without punctuation at their ends; words of nothing else become empty."""
    return F.transform(words(c), lambda w: F.btrim(w, F.lit(EDGE_SIGNS)))


def after_context(c: Column) -> Column:
    """What follows the first context mark; null without one."""
    return F.try_element_at(F.split(c, CONTEXT_MARK, 2), F.lit(2))


def to_number(c: Column) -> Column:
    """The number that a text stands for, else 0. NaN stays: it isn't below any threshold."""
    return F.coalesce(c.try_cast("double"), F.lit(0.0))


def tag(c: Column) -> Column:
    """A name fit for files: every run of other characters is one underscore."""
    return F.regexp_replace(c, "[^A-Za-z0-9._-]+", "_")


def clip(c: Column, most: int = 300) -> Column:
    """One line of at most ``most`` characters, with dots if more was there."""
    line = F.replace(c, F.lit("\n"), F.lit(" ⏎ "))
    return F.when(F.char_length(line) > most, F.concat(F.substring(line, 1, most), F.lit("..."))).otherwise(line)


def token_estimate(c: Column, per_word: int = 3) -> Column:
    """Tokens of a text when no tokenizer is at hand: words times a constant."""
    return word_count(c) * per_word
