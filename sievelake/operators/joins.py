"""Joins that keep a dataset and what was made for it together."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def not_done(todo: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """Rows still to do."""
    return todo.join(done.select(key), key, "left_anti")


def with_membership(df: DataFrame, clean: DataFrame, key: str = "id", name: str = "clean") -> DataFrame:
    """Rows with whether their id is in ``clean``."""
    return df.join(clean.select(key).distinct().withColumn(name, F.lit(True)), key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def last_by(df: DataFrame, key: str, seq: str, columns: list[str]) -> DataFrame:
    """Of rows with one key, the last."""
    return df.groupBy(key).agg(F.max_by(F.struct(*columns), seq).alias("__s")).select(key, "__s.*")


def updated(target: DataFrame, source: DataFrame, key: str, column: str) -> DataFrame:
    """``target`` with ``column`` overwritten where ``source`` has the key."""
    new = source.select(key, F.col(column).alias("__new"), F.lit(True).alias("__hit"))
    return target.join(new, key, "left").withColumn(column, F.when(F.col("__hit"), F.col("__new")).otherwise(F.col(column))).drop("__new", "__hit")


def filled_predictions(template: DataFrame, base: DataFrame, distilled: DataFrame, key: str = "eval_id") -> DataFrame:
    """The template with both models' outputs; seconds and token counts only where it has such columns.

    ``base`` and ``distilled``: key, text, seconds, new_tokens.  Rows must match one to one.
    """
    missing = {"base_output", "distilled_output"} - set(template.columns)
    if missing:
        raise ValueError(f"the template lacks {sorted(missing)}")
    out = template
    for name, rows in (("base", base), ("distilled", distilled)):
        given = rows.select(key, F.col("text").alias("__text"), F.round("seconds", 3).alias("__seconds"), F.col("new_tokens").alias("__tokens"))
        out = out.join(given, key)
        for column, value in ((f"{name}_output", "__text"), (f"{name}_seconds", "__seconds"), (f"{name}_new_tokens", "__tokens")):
            if column in template.columns:
                out = out.withColumn(column, F.col(value))
        out = out.drop("__text", "__seconds", "__tokens")
    return out.select(template.columns)


def same_text(a: DataFrame, b: DataFrame, key: str = "eval_id", column: str = "text") -> DataFrame:
    """One row: compared rows, and how many have equal texts."""
    both = a.select(key, F.col(column).alias("x")).join(b.select(key, F.col(column).alias("y")), key)
    return both.agg(F.count("*").alias("n"), F.count_if(F.col("x") == F.col("y")).alias("identical"))


def attach_replies(batched: DataFrame, replies: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Rows of batches (batch_id, i, ...) with what the reply to their batch says of them.

    ``replies``: batch_id, reply (JSON list of objects with i and the fields, parsed tolerantly before).  Rows that the
    reply leaves out, or gives no value for a field, have nulls; of two objects for one place the last counts.
    """
    shape = F.lit("array<struct<i:int," + ",".join(f"{f}:double" for f in fields) + ">>")
    told = replies.select("batch_id", F.posexplode(F.from_json("reply", shape)).alias("at", "r")).filter("r.i is not null")
    told = told.groupBy("batch_id", F.col("r.i").alias("i")).agg(F.max_by("r", "at").alias("r"))
    return batched.join(told, ["batch_id", "i"], "left").select(*batched.columns, *(F.col(f"r.{f}").alias(f) for f in fields))


def turn_pairs(turns: DataFrame) -> DataFrame:
    """(id, conv_id, turn, prompt, response): each user turn with the assistant turn right behind it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    both = turns.withColumn("next_role", F.lead("role").over(w)).withColumn("response", F.lead("text").over(w))
    both = both.filter((F.col("role") == "user") & (F.col("next_role") == "assistant"))
    return both.select(F.concat_ws("|", "conv_id", "turn").alias("id"), "conv_id", "turn", F.col("text").alias("prompt"), "response")
