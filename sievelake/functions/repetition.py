"""Looping, repeating, copying and restating answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import contain, grams_unspaced, let, norm, words


def runs(ws: Column, n: int) -> Column:
    """All runs of ``n`` consecutive words, each as one text (words hold no white space)."""
    starts = F.when(F.size(ws) >= n, F.sequence(F.lit(1), F.size(ws) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.concat_ws(" ", F.slice(ws, i, n)))


def is_looping(c: Column, least_words: int = 12, most: float = 0.3) -> Column:
    """Whether over ``most`` of a text's three-word runs are repeats; a short text never is."""

    def of(ws: Column) -> Column:
        return F.when(F.size(ws) < least_words, F.lit(False)).otherwise(let(runs(ws, 3), lambda r: 1 - F.size(F.array_distinct(r)) / F.size(r) > most))

    return let(words(c), of)


def repeats(c: Column) -> Column:
    """Whether a word follows itself or a two-word run occurs twice."""

    def of(ws: Column) -> Column:
        pairs = F.zip_with(ws, F.slice(ws, 2, F.greatest(F.size(ws) - 1, F.lit(0))), lambda a, b: a == b)
        return F.coalesce(F.exists(F.filter(pairs, lambda p: p.isNotNull()), lambda p: p), F.lit(False)) | let(runs(ws, 2), lambda r: F.size(r) != F.size(F.array_distinct(r)))

    return let(words(c), of)


def copy_share(answer: Column, prompt: Column) -> Column:
    """Share of the answer's character 4-grams that the prompt has, blanks left out."""
    return contain(grams_unspaced(norm(answer)), grams_unspaced(norm(prompt)))


def restates(answer: Column, prompt: Column, k: int = 5) -> Column:
    """Whether the answer's first ``k`` folded words stand in the folded prompt, one after the other."""
    ws = F.filter(F.split(norm(answer), " "), lambda w: w != "")
    return (F.size(ws) >= k) & F.contains(norm(prompt), F.array_join(F.slice(ws, 1, k), " "))
