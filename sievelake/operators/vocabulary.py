"""Word counts of a corpus, and words that look like two frequent words stuck together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scripts import ETHIOPIC
from ..functions.text import EDGE_SIGNS, SPACE, bare_words
from .storage import stored


def _counted(df: DataFrame, text: str, *first: Column) -> DataFrame:
    """(word, n, and aggregates ``first``): words are counted as they stand, then without punctuation at their ends, empty ones left out."""
    raw = df.withColumn("__w", F.explode(F.split(F.col(text), SPACE))).groupBy("__w").agg(F.count("*").alias("n"), *first)
    return raw.withColumn("word", F.btrim("__w", F.lit(EDGE_SIGNS))).filter("word <> ''")


def word_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) over all texts; words without punctuation at their ends, empty ones left out."""
    return _counted(df, text).groupBy("word").agg(F.sum("n").alias("n"))


def own_glued_rows(df: DataFrame, gate: str = f"[{ETHIOPIC}]") -> DataFrame:
    """Ids of rows (id, text) that have a word glued by the counts of these same rows.

    A glued word occurs once, so its row comes with its count and the texts are read once.
    """
    counts = _counted(df, "text", F.min("id").alias("id")).groupBy("word").agg(F.sum("n").alias("n"), F.min("id").alias("id"))
    counts = stored(counts, "word_counts")
    return counts.join(glued_words(counts.select("word", "n"), gate), "word", "left_semi").select("id").distinct()


def glued_words(counts: DataFrame, gate: str = f"[{ETHIOPIC}]", least_part: int = 2, most_whole: int = 1, part_count: int = 5) -> DataFrame:
    """(word): rare words that a cut parts into two frequent ones.

    Only distinct rare words are cut, and their parts meet the frequent words in two joins on the part.
    """
    often = counts.filter(F.col("n") >= part_count).select("word")
    rare = counts.filter((F.col("n") <= most_whole) & (F.char_length("word") >= 2 * least_part + 1) & F.col("word").rlike(gate))
    cuts = rare.select("word", F.explode(F.sequence(F.lit(least_part), F.char_length("word") - least_part)).alias("k"))
    cuts = cuts.select("word", F.expr("left(word, k)").alias("head"), F.expr("substr(word, k + 1)").alias("rest"))
    return cuts.join(often.withColumnRenamed("word", "head"), "head", "left_semi").join(often.withColumnRenamed("word", "rest"), "rest", "left_semi").select("word").distinct()


def rows_with_glued_words(df: DataFrame, counts: DataFrame, gate: str = f"[{ETHIOPIC}]") -> DataFrame:
    """Ids of rows (id, text) that have a glued word."""
    return df.select("id", F.explode(bare_words(F.col("text"))).alias("word")).join(glued_words(counts, gate), "word", "left_semi").select("id").distinct()
