"""Mixing sources to target weights by Pareto order sampling; DataFrame functions only.

Targets: every source gets its weight's part of the wanted number of words, but no more than ``most_copies`` times
its own; what is above is shared again by weight (water-filling, in one window over the sources).

Copies: of a target of r times its source's words each document gets floor(r) certain whole copies.  The rest is
sampled: a document's inclusion probability is proportional to its weight, in such a measure that the words expected are
the words wanted; where it reaches 1, one more whole copy is certain, and what that leaves is shared again among
the others.  Documents are taken in ascending order of ``odds(random) / odds(inclusion)``, certain ones first, passing over each
that has more words than are still missing, until none fits.  That rank is a fixed number for each document
(a hash of seed, id and text), so reruns agree, and a sample has a fixed size instead of a random one.

Where the order is cut is found without sorting a source: the rank axis is cut into about sqrt(n) bins, the
words of each bin are summed, and only the bin that holds the cut is sorted.  The same is done behind each cut, with
the documents that still fit, until no source has one: as if the order were walked one document at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import NOT_BLANKS, Scratch, stored, unit_random

WEIGHTS, SHARE, MOST_COPIES = (5.0, 2.0, 1.0), 1.5, 2.0


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most_copies: float = MOST_COPIES) -> DataFrame:
    """``target`` of each row of ``sizes`` (source, source_size).

    Sources by code point, null last, take the weights in turn.  All windows run over sources, not rows.
    """
    everywhere = Window.partitionBy()
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.get(F.array(*map(F.lit, weights)), F.pmod(turn, F.lit(len(weights))))
    fill = Window.orderBy("room", "turn").rowsBetween(Window.unboundedPreceding, -1)
    t = sizes.withColumn("turn", turn).withColumn("w", w).withColumn("cap", F.lit(most_copies) * F.col("source_size")).withColumn("room", F.col("cap") / F.col("w"))
    left = F.lit(share) * F.sum("source_size").over(everywhere) - F.coalesce(F.sum("cap").over(fill), F.lit(0.0))
    t = t.withColumn("level", left / (F.sum("w").over(everywhere) - F.coalesce(F.sum("w").over(fill), F.lit(0.0))))
    # The first source, by room for its weight, that the level doesn't fill sets the level of all after it.
    t = t.withColumn("level", F.min(F.when(F.col("level") < F.col("room"), F.struct("room", "turn", "level"))).over(everywhere)["level"])
    return t.select("source", F.coalesce(F.least("cap", F.col("level") * F.col("w")), F.col("cap")).alias("target"))


def odds(p: Column) -> Column:
    return p / (1 - p)


def mix(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weight_col: str | None = None,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    most_copies: float = MOST_COPIES,
    seed: int = 42,
) -> DataFrame:
    """One row out for each row in: ``id_col``, ``size`` (words), ``source_size``, ``target`` (its source's),
    ``taken`` (words the mix takes: copies times size) and ``copies``.

    A document's weight is that in ``weight_col``, or the logarithm of its size.  Null and empty texts have size 0 and no
    copies beyond the certain ones.  Null sources are one source.  Repeated rows count as rows of their own; which of them is
    taken is arbitrary, how many isn't.  A weight that is null, not a number or not above 0 counts as 0: such a row is sampled
    last.  Other columns are ignored, whatever their names.  An empty table gives an empty result.
    """
    scratch = Scratch(df.sparkSession, "mix")
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(NOT_BLANKS)), F.lit(0)).cast("bigint")
    weight = F.log1p(size.cast("double")) if weight_col is None else F.nanvl(F.coalesce(F.col(weight_col).cast("double"), F.lit(0.0)), F.lit(0.0))
    docs = scratch(
        df.select(
            F.col(id_col).alias("id"),
            F.col(source_col).alias("source"),
            size.alias("size"),
            F.greatest(weight, F.lit(0.0)).alias("weight"),
            unit_random(seed, F.col(id_col), F.col(text_col)).alias("u"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "mix_docs",
    )
    sizes = docs.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    sizes = scratch(sizes, "mix_sizes")
    plan = sizes.join(source_targets(sizes, weights, share, most_copies).withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = plan.withColumn("certain", F.floor(ratio + F.lit(1e-12)).cast("bigint"))
    plan = plan.withColumn("wanted", F.greatest(F.col("target") - F.col("certain") * F.col("source_size"), F.lit(0.0)))
    plan = scratch(plan.withColumn("f", F.when(F.col("source_size") > 0, F.col("wanted") / F.col("source_size")).otherwise(0.0)), "mix_plan")

    def beside(other: DataFrame, rows: DataFrame) -> DataFrame:
        """Rows with what ``other`` has for their source. Other is one row a source: Spark broadcasts it if its size allows."""
        return rows.join(other.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")

    # The factor from weight to inclusion: with each round those that reach 1 count whole, until no further one does.
    factors, held = plan.select("source", F.lit(0.0).alias("factor")), -1
    while True:
        now = beside(factors, docs)
        whole = (F.col("weight") > 0) & (F.col("factor") * F.col("weight") >= 1)
        now = now.groupBy("source").agg(F.sum(F.when(whole, F.col("size")).otherwise(0)).alias("whole"), F.sum(F.when(whole, 0.0).otherwise(F.col("size") * F.col("weight"))).alias("rest"), F.count_if(whole).alias("n_whole"))
        now = beside(now, plan.select("source", "wanted")).withColumn("left", F.greatest(F.col("wanted") - F.col("whole"), F.lit(0.0)))
        factors = scratch(now.select("source", F.when(F.col("rest") > 0, F.col("left") / F.col("rest")).otherwise(F.when(F.col("left") > 0, F.lit(float("inf"))).otherwise(0.0)).alias("factor"), "whole", "n_whole"), "mix_factors")
        reached = factors.agg(F.coalesce(F.sum("n_whole"), F.lit(0))).first()[0]
        if reached == held:
            break
        held, factors = reached, factors.select("source", "factor")
    plan = scratch(beside(factors.drop("n_whole"), plan), "mix_plan")

    share_of = F.when(F.col("weight") > 0, F.col("factor") * F.col("weight")).otherwise(0.0)
    inclusion = F.least(F.greatest(share_of, F.lit(1e-9)), F.lit(1 - 1e-9))
    rank = F.when(share_of >= 1, 0.0).otherwise(odds(F.col("u")) / odds(inclusion))
    # Certain ones, which always fit together, aren't walked.
    first = (F.col("rank") == 0) & (F.col("f") > 0)
    # rank / (1 + rank) lies in (0, 1) in the same order; it spreads the bins.
    ranked = beside(plan, docs).withColumn("rank", rank).withColumn("bin", F.floor(F.col("rank") / (1 + F.col("rank")) * F.ceil(F.sqrt("n"))))

    key = F.struct("rank", "row")
    # What is taken of a source: documents in (start, cut] of the order that have no more than ``most`` words, for each round.
    place = "struct<rank:double,row:bigint>"
    none = F.array().cast(f"array<struct<start:{place},cut:{place},most:double>>")
    state = plan.select("source", "wanted", F.col("whole").cast("bigint").alias("used"), F.lit(None).cast(place).alias("last"), none.alias("rounds"))
    while True:
        ahead = beside(state.drop("wanted", "rounds"), ranked).withColumn("gap", F.col("wanted") - F.col("used"))
        ahead = ahead.filter((F.col("size") <= F.col("gap")) & (F.col("last").isNull() | (key > F.col("last"))) & (F.col("size") > 0) & (F.col("f") > 0) & (F.col("rank") > 0))
        bins = ahead.groupBy("source", "bin", "gap").agg(F.sum("size").alias("words"))
        before = F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        # The edge is the bin in which the words run out, or the last bin of all.
        edge = bins.withColumn("before", before).filter("before <= gap").groupBy("source").agg(F.max("bin").alias("edge"), F.max("before").alias("before"))
        inside = beside(edge, ahead).filter("bin = edge")
        order = Window.partitionBy("source").orderBy("rank", "row")
        inside = inside.withColumn("sum", F.col("before") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        fits = F.col("sum") <= F.col("gap")
        # The first that doesn't fit ends the round: the next one is behind it.  Without one the source is done.
        ends = inside.groupBy("source").agg(F.min(F.when(~fits, key)).alias("stop"), F.coalesce(F.max(F.when(fits, F.col("sum"))), F.first("before")).alias("sum"))
        ends = scratch(ends, "mix_cut")
        if ends.isEmpty():
            break
        last = F.coalesce("stop", F.struct(F.lit(float("inf")).alias("rank"), F.lit(0).cast("bigint").alias("row")))
        round_ = F.struct(F.col("last").alias("start"), last.alias("cut"), (F.col("wanted") - F.col("used")).cast("double").alias("most"))
        state = state.join(ends.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").select(
            "source",
            "wanted",
            (F.col("used") + F.coalesce("sum", F.lit(0))).alias("used"),
            F.when(F.col("sum").isNull(), F.col("last")).otherwise(last).alias("last"),
            F.when(F.col("sum").isNull(), F.col("rounds")).otherwise(F.concat("rounds", F.array(round_))).alias("rounds"),
        )
        state = scratch(state, "mix_state")
    # The document at the cut is the one that didn't fit.
    within = lambda r: (r["start"].isNull() | (key > r["start"])) & (key < r["cut"]) & (F.col("size") <= r["most"])
    chosen = (F.col("size") > 0) & (first | ((F.col("rank") > 0) & F.exists("rounds", within)))
    state = state.select("source", "rounds")
    copies = F.col("certain") + chosen.cast("bigint")
    copies = F.when(F.col("f") > 0, copies).otherwise(F.col("certain"))
    out = beside(state, ranked).select(
        F.col("id").alias(id_col),
        "size",
        F.col("source_size").cast("bigint").alias("source_size"),
        F.col("target").cast("double").alias("target"),
        (copies * F.col("size")).alias("taken"),
        copies.alias("copies"),
    )
    out = stored(out, "mix")
    scratch.drop()
    return out
