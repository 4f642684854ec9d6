"""Reproducible choices: quotas, round-robin, strata, splits, blinding, batches.

The order of every draw is the MD5 of seed and id, so it's the same on every run, engine and partitioning; ties (equal
ids) fall to the id itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import numbered_by

# Fixed value: the seed of the data pipeline; the rating study has its own.
SEED, RATING_SEED = 42, 11


def draw(seed: int, *ids: str) -> Column:
    return F.md5(F.concat_ws("-", F.lit(str(seed)), *(F.col(c).cast("string") for c in ids)))


def ranked(df: DataFrame, groups: tuple[str, ...], order: list[Column], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*groups).orderBy(*order)))


#: A group's rows are ranked in so many parts first, and only the best of each part together.
PARTS = 64


def best(df: DataFrame, groups: tuple[str, ...], order: list[Column], cap: Column, by: str) -> DataFrame:
    """Rows among the first ``cap`` of their group, and some others: those that are so in their part of the group (``by``).

    A later ranking of the whole group then has at most PARTS times ``cap`` rows of it in one task.
    """
    part = df.withColumn("__part", F.pmod(F.xxhash64(by), F.lit(PARTS)))
    return ranked(part, (*groups, "__part"), order, "__k").filter(F.col("__k") <= cap).drop("__part", "__k")


def first_k(df: DataFrame, groups: tuple[str, ...], k: int, order: str = "seq") -> DataFrame:
    """The first k rows of each group."""
    return ranked(df, groups, [F.col(order)]).filter(F.col("rank") <= k).drop("rank")


def quota(df: DataFrame, groups: tuple[str, ...], cap: Column, id_col: str = "id", seed: int = SEED) -> DataFrame:
    """At most ``cap`` rows of each group, drawn at random. ``cap`` may depend on the group (halves for directions)."""
    order = [draw(seed, id_col), F.col(id_col)]
    return ranked(best(df, groups, order, cap, id_col), groups, order).filter(F.col("rank") <= cap).drop("rank")


def round_robin(df: DataFrame, groups: tuple[str, ...], pool: str, cap: Column, id_col: str = "id", seed: int = SEED) -> DataFrame:
    """The same, but the pools of a group take turns, from the pool whose first row comes first in the draw."""
    df = df.withColumn("__h", draw(seed, id_col))
    df = best(df, (*groups, pool), [F.col("__h"), F.col(id_col)], cap, id_col)
    df = ranked(df, (*groups, pool), [F.col("__h"), F.col(id_col)], "__r")
    df = df.withColumn("__p", F.min("__h").over(Window.partitionBy(*groups, pool)))
    return ranked(df, groups, [F.col("__r"), F.col("__p"), F.col(id_col)]).filter(F.col("rank") <= cap).drop("rank", "__h", "__r", "__p")


def stratified(df: DataFrame, group: str, n: int, id_col: str = "id", seq: str = "seq", seed: int = SEED) -> DataFrame:
    """About ``n`` rows, ceil(n / groups) of each group in its draw; groups in order of their first row, then cut to n."""
    first = df.groupBy(group).agg(F.min(seq).alias("__first"))
    groups = max(1, first.count())
    per = -(-n // groups)
    order = [draw(seed, id_col), F.col(id_col)]
    picked = ranked(best(df, (group,), order, F.lit(per), id_col), (group,), order).filter(F.col("rank") <= per).join(first, group)
    return picked.orderBy("__first", "rank").limit(n).drop("__first", "rank")


def split(df: DataFrame, validation: int = 100, id_col: str = "id", seed: int = SEED) -> DataFrame:
    """``fold``: 'val' for the first ``validation`` rows of the draw, else 'train'.

    The cut is the draw's value of that row: found by a top-k, so no window holds all rows.
    """
    h = draw(seed, id_col)
    last = df.select(h.alias("h"), F.col(id_col).alias("i")).orderBy("h", "i").limit(validation).agg(F.max(F.struct("h", "i")).alias("cut")).first()["cut"]
    if last is None or validation < 1:
        return df.withColumn("fold", F.lit("train"))
    return df.withColumn("fold", F.when((h < last["h"]) | ((h == last["h"]) & (F.col(id_col) <= last["i"])), "val").otherwise("train"))


def blind(df: DataFrame, id_col: str = "eval_id", seed: int = RATING_SEED) -> DataFrame:
    """``A_is`` and ``B_is``: which model is shown as A and which as B, by a fair draw."""
    swap = F.conv(F.substring(draw(seed, id_col), 1, 1), 16, 10).cast("int") % 2 == 1
    return df.withColumn("A_is", F.when(swap, "distilled").otherwise("base")).withColumn("B_is", F.when(swap, "base").otherwise("distilled"))


def batches(df: DataFrame, size: int, groups: tuple[str, ...] = (), order: str = "seq") -> DataFrame:
    """``batch_id`` and ``i``: consecutive rows in batches of ``size``, numbered from 0 inside each group.

    Rows are numbered over ranges of group and order, so a large group is several tasks' work.
    """
    df = numbered_by(df, *groups, F.col(order), name="rank")
    if groups:
        first = df.groupBy(*(F.col(g).alias(f"__g{i}") for i, g in enumerate(groups))).agg(F.min("rank").alias("__first"))
        same = [F.col(g).eqNullSafe(F.col(f"__g{i}")) for i, g in enumerate(groups)]
        df = df.join(first, same).withColumn("rank", F.col("rank") - F.col("__first") + 1).drop("__first", *(f"__g{i}" for i in range(len(groups))))
    return df.withColumn("batch_id", F.floor((F.col("rank") - 1) / size).cast("bigint")).withColumn("i", ((F.col("rank") - 1) % size).cast("int")).drop("rank")


def length_batches(df: DataFrame, size: int, length: str, id_col: str = "id", seed: int = SEED, chunk: int = 16) -> DataFrame:
    """Batches of similar length: the draw is cut into chunks of ``chunk`` batches, each sorted by length and cut into
    batches, which are drawn again. ``batch_id`` numbers them in their final order, ``i`` the rows inside."""
    df = numbered_by(df, draw(seed, id_col), F.col(id_col), name="__n").withColumn("__chunk", F.floor((F.col("__n") - 1) / (size * chunk)))
    df = ranked(df, ("__chunk",), [F.col(length), F.col(id_col)], "__r")
    df = df.withColumn("__b", F.floor((F.col("__r") - 1) / size)).withColumn("i", ((F.col("__r") - 1) % size).cast("int"))
    final = numbered_by(df.select("__chunk", "__b").distinct(), draw(seed + 1, "__chunk", "__b"), name="batch_id").withColumn("batch_id", F.col("batch_id") - 1)
    return df.join(final, ["__chunk", "__b"]).drop("__n", "__chunk", "__b", "__r")
