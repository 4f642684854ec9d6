"""Blind ratings of two models' answers: means, and who wins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIELDS = ("fluency_A", "correct_A", "fluency_B", "correct_B")


def complete(ratings: DataFrame) -> DataFrame:
    """Ratings with all four fields set."""
    ok = F.lit(True)
    for f in FIELDS:
        ok = ok & F.coalesce(F.col(f).cast("int") != 0, F.lit(False))
    return ratings.filter(ok)


def still_open(items: DataFrame, ratings: DataFrame, key: str = "eval_id") -> DataFrame:
    """Items without a complete rating."""
    return items.join(complete(ratings).select(key), key, "left_anti")


def save(ratings: DataFrame, path: str) -> None:
    """The rating file anew: complete ratings alone, in the order of their ids."""
    from ..sources.sinks import write_csv

    write_csv(complete(ratings).select("eval_id", *FIELDS).orderBy("eval_id"), path)


def by_model(ratings: DataFrame, key: DataFrame, tasks: DataFrame) -> DataFrame:
    """(eval_id, task, fluency_base, fluency_distilled, correct_base, correct_distilled): the blinding undone."""
    rows = ratings.join(key, "eval_id").join(tasks.select("eval_id", "task"), "eval_id")
    first = F.col("A_is") == "base"

    def pick(metric: str, base: bool):
        a, b = F.col(f"{metric}_A").cast("int"), F.col(f"{metric}_B").cast("int")
        return F.when(first if base else ~first, a).otherwise(b).alias(f"{metric}_{'base' if base else 'distilled'}")

    return rows.select("eval_id", "task", *(pick(m, b) for m in ("fluency", "correct") for b in (True, False)))


def summary(rated: DataFrame) -> DataFrame:
    """Per task, and over all as OVERALL: n, mean ratings (unrounded), wins, ties and losses on correctness."""
    better = F.col("correct_distilled") - F.col("correct_base")
    out = rated.rollup("task").agg(
        F.grouping("task").alias("__all"),
        F.count("*").alias("n"),
        *(F.avg(f"{m}_{k}").alias(f"{m}_{k}") for m in ("fluency", "correct") for k in ("base", "distilled")),
        F.count_if(better > 0).alias("wins_distilled"),
        F.count_if(better == 0).alias("ties"),
        F.count_if(better < 0).alias("wins_base"),
    )
    return out.withColumn("task", F.when(F.col("__all") == 1, "OVERALL").otherwise(F.col("task"))).orderBy("__all", "task").drop("__all")
