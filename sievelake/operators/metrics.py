"""Metrics of generated texts, runs and training."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from ..functions.repetition import copy_share, is_looping, repeats
from ..functions.scripts import script_fits
from ..functions.text import strip, word_count

# Fixed value: the longest generation, in tokens.
MOST_NEW_TOKENS = 256


def percent(c: Column) -> Column:
    """Aggregate: percentage of rows for which a condition holds."""
    return 100 * F.avg(c.cast("int"))


def generation_metrics(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Per group of ``df`` (keys, text, direction, new_tokens; prompt for the copy rate): unrounded metrics."""
    text = F.col("text")
    out = [
        F.count("*").alias("n"),
        percent(script_fits(text, F.col("direction"))).alias("right_script_pct"),
        percent(strip(text) == "").alias("empty_pct"),
        percent(is_looping(text)).alias("looping_pct"),
        percent(repeats(text)).alias("repeat_loose_pct"),
        percent(F.col("new_tokens") >= MOST_NEW_TOKENS).alias("hit_256_pct"),
        F.avg("new_tokens").alias("mean_new_tokens"),
    ]
    if "prompt" in df.columns:
        df = df.withColumn("__copied", copy_share(text, F.col("prompt")))
        out.append(F.avg("__copied").alias("copy_rate"))
    return df.groupBy(*keys).agg(*out)


def mean_shares(df: DataFrame, keys: tuple[str, ...], shares: dict[str, Column]) -> DataFrame:
    """Per group: the mean of each share of letters, over rows."""
    return df.groupBy(*keys).agg(*(F.avg(c).alias(name) for name, c in shares.items()))


def run_stats(df: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Per run of ``df`` (keys, seconds, new_tokens): time per answer, tokens per second as a ratio of sums, and how many
    answers are as long as they may be."""
    return df.groupBy(*keys).agg(
        F.avg("seconds").alias("sec_per_answer_mean"),
        F.percentile("seconds", F.lit(0.5)).alias("sec_per_answer_median"),
        (F.sum("new_tokens") / F.sum("seconds")).alias("tokens_per_sec"),
        F.sum("new_tokens").alias("total_new_tokens"),
        F.count_if(F.col("new_tokens") >= MOST_NEW_TOKENS).alias("n_hit_256"),
    )


def nearest_ranks(df: DataFrame, groups: tuple[str, ...], value: str, percents: dict[str, float]) -> DataFrame:
    """Per group, for each name in ``percents``: the value at place ``min(n - 1, floor(p / 100 * n))`` of the sorted values.

    No built-in percentile is this one. Values are counted first, so what is sorted, even for a group that has most rows, is its
    distinct values. Nulls don't count; without groups an empty table gives zeros.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count("*").alias("__c"))
    own = Window.partitionBy(*groups)
    counts = counts.withColumn("__n", F.sum("__c").over(own)).withColumn("__upto", F.sum("__c").over(own.orderBy(value)))
    place = lambda p: F.least(F.col("__n") - 1, F.floor(F.lit(p) / 100 * F.col("__n")))
    at = {name: F.min(F.when(F.col("__upto") > place(p), F.col(value))) for name, p in percents.items()}
    return counts.groupBy(*groups).agg(*((c if groups else F.coalesce(c, F.lit(0))).alias(name) for name, c in at.items()))


def weighted_mean(value: Column, weight: Column) -> Column:
    """Aggregate: mean of losses by their token counts."""
    return F.sum(value * weight) / F.sum(weight)


def fertility(df: DataFrame, keys: tuple[str, ...], tokens: Column, text: str = "text") -> DataFrame:
    """Tokens a word and tokens a character, as ratios of sums; ``tokens``: count of a tokenizer of choice."""
    return df.groupBy(*keys).agg(
        (F.sum(tokens) / F.sum(word_count(F.col(text)))).alias("tokens_per_word"),
        (F.sum(tokens) / F.sum(F.char_length(text))).alias("tokens_per_char"),
    )


CHAR_ORDER, WORD_ORDER, BETA = 6, 2, 2.0
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _pieces(ws: Column) -> Column:
    """Words with one punctuation sign at the end, or else at the start, parted from them."""
    signs = "".join("\\" + c for c in PUNCTUATION)

    def cut(w: Column) -> Column:
        n = F.char_length(w)
        last, first = F.substring(w, -1, 1), F.substring(w, 1, 1)
        head, tail = F.left(w, F.greatest(n - 1, F.lit(0))), F.right(w, F.greatest(n - 1, F.lit(0)))
        return F.when(n <= 1, F.array(w)).when(last.rlike(f"[{signs}]"), F.array(head, last)).when(first.rlike(f"[{signs}]"), F.array(first, tail)).otherwise(F.array(w))

    return F.flatten(F.transform(ws, cut))


#: Rows whose n-grams are counted together.
CHRF_ROWS = 256


def ngram_matches(units: list[np.ndarray], sizes: list[np.ndarray], orders: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each order, by row: n-grams of the first side, of the second, and the sum of the smaller counts.

    ``units``: whole numbers of all rows' texts, one behind the other, for both sides; ``sizes``: how many of them each row has.
    N-grams of a row are numbered: that of order n is the number of the one before it and its last unit, so nothing is hashed.
    """
    rows, split = sizes[0].size, units[0].size
    row = np.concatenate([np.repeat(np.arange(rows), s) for s in sizes])
    left = np.concatenate([np.arange(s.sum()) - np.repeat(np.cumsum(s) - s, s) for s in sizes])
    left = np.concatenate([np.repeat(s, s) for s in sizes]) - left  # units from here to the text's end
    unit, last = np.unique(np.concatenate(units), return_inverse=True)
    place, ids, of = np.arange(row.size), row, None
    for n in range(1, orders + 1):
        stays = left[place] >= n
        place, ids = place[stays], ids[stays]
        found, ids = np.unique(ids.astype(np.int64) * max(1, unit.size) + last[place + n - 1], return_inverse=True)
        of = np.zeros(found.size, dtype=np.int64)
        of[ids] = row[place]
        first = place < split
        h, r = np.bincount(ids[first], minlength=found.size), np.bincount(ids[~first], minlength=found.size)
        yield tuple(np.bincount(of, x, rows).astype(np.int64) for x in (h, r, np.minimum(h, r)))


def chrf(df: DataFrame, keys: tuple[str, ...], hypothesis: str = "text", reference: str = "teacher") -> DataFrame:
    """Corpus chrF++ (0 to 100) per group: character n-grams of order 1 to 6 without white space, word n-grams of order 1
    and 2, F-score with beta 2, averaged over the orders that both sides have.

    Each text's n-grams are counted, matches are the smaller of both counts, and all is summed by group and order before
    the score.  The counts are made where rows are read (Arrow batches); a row leaves as three numbers an order.
    """
    side = lambda c: (F.regexp_replace(F.col(c), r"(?U)\s", ""), _pieces(F.filter(F.split(F.col(c), r"(?U)\s+"), lambda w: w != "")))
    (hc, hw), (rc, rw) = side(hypothesis), side(reference)
    rows = df.select(*keys, hc.alias("__hc"), rc.alias("__rc"), hw.alias("__hw"), rw.alias("__rw"))
    kinds = StructType([rows.schema[k] for k in keys] + [StructField(c, ArrayType(LongType())) for c in "hrm"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, CHRF_ROWS):
                part = batch.slice(start, CHRF_ROWS)
                hc, rc, hw, rw = (part.column(len(keys) + i) for i in range(4))
                chars = [np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4") for texts in (hc.fill_null("").to_pylist(), rc.fill_null("").to_pylist())]
                sizes = [pc.fill_null(pc.utf8_length(c), 0).to_numpy(zero_copy_only=False) for c in (hc, rc)]
                found = [*ngram_matches(chars, sizes, CHAR_ORDER)]
                words = pa.concat_arrays([hw.flatten(), rw.flatten()]).dictionary_encode().indices.to_numpy(zero_copy_only=False)
                sizes = [pc.fill_null(pc.list_value_length(c), 0).to_numpy(zero_copy_only=False) for c in (hw, rw)]
                found += ngram_matches(np.split(words, [int(sizes[0].sum())]), sizes, WORD_ORDER)
                lists = [pa.ListArray.from_arrays(np.arange(0, part.num_rows * len(found) + 1, len(found), dtype=np.int32), np.stack([f[i] for f in found], axis=1).ravel()) for i in range(3)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keys)], *lists], names=[*keys, *"hrm"])

    each = rows.mapInArrow(count, kinds).select(*keys, F.posexplode(F.arrays_zip("h", "r", "m")).alias("o", "x")).filter("x.h > 0 or x.r > 0")
    sums = each.groupBy(*keys, "o").agg(*(F.sum(f"x.{c}").alias(c) for c in "hrm"))
    precision, recall = F.col("m") / F.col("h"), F.col("m") / F.col("r")
    low = BETA**2 * precision + recall
    score = F.when((F.col("h") > 0) & (F.col("r") > 0), F.when(low > 0, (1 + BETA**2) * precision * recall / low).otherwise(0.0))
    return sums.withColumn("f", score).groupBy(*keys).agg((100 * F.coalesce(F.avg("f"), F.lit(0.0))).alias("chrf"))
