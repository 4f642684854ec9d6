"""Exact deduplication in three combining steps that no hot text can unbalance; DataFrame functions only.

1. Local: rows are aggregated by (digest, whole text) inside their task, so a task sends each text once.
2. Salted: what the tasks send is combined by (digest, salt, text); the salt is the task's, so the copies of one
   text meet in up to SALTS places instead of one.
3. Global: the winners of the salts are combined by (digest, text).

The whole text is part of the key of each step: texts that merely share a digest are never one group.  The groups then go
back to their rows by digest; rows of very large groups are salted for that, too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import BLANKS, spread_join, stored, whole

SALTS = 16
LARGEST = 2**63 - 1


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS + "+", "")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row out for each row in: ``id_col``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal if they are after deleting blanks, tabs and line ends (null counts as empty).  Of equal
    texts the row with the most code points in its original text stays, then the one with the smallest id (an
    integer; a null id comes last).  Rows that share both id and text are one row repeated: all of them are marked
    ``kept`` or none (drop the repetitions by id).  An empty table gives an empty result.  Other columns are ignored.
    """
    body = normalised(F.col(text_col))
    rows = df.select(
        F.col(id_col).alias("id"),
        F.unhex(F.sha2(body, 256)).alias("digest"),
        body.alias("body"),
        F.char_length(F.coalesce(F.col(text_col), F.lit(""))).alias("size"),
    )
    # The better row has the larger number: more code points, then the smaller id. A number, not a struct, so that
    # the aggregates hash instead of sorting whole texts. It holds 31 bits of size above 20 digits of id.
    before = F.coalesce(whole(LARGEST + 1) - F.col("id").cast("decimal(20,0)"), whole(0))
    better = (F.col("size").cast("decimal(10,0)") * whole(10**20) + before).cast("decimal(38,0)")
    salted = (
        rows.select("digest", "body", better.alias("best"), (F.spark_partition_id() % SALTS).alias("salt"))
        .groupBy("digest", "body", "salt")
        .agg(F.max("best").alias("best"), F.count("*").alias("n"))
    )
    groups = salted.groupBy("digest", "body").agg(F.max("best").alias("best"), F.sum("n").alias("n"))

    def winner(rows: DataFrame) -> DataFrame:
        rest = F.pmod(F.col("best"), whole(10**20)) - 1
        return rows.withColumn("keep_id", F.when(rest >= 0, (whole(LARGEST) - rest).cast("bigint")))

    by_digest = winner(groups.groupBy("digest").agg(F.max("best").alias("best"), F.sum("n").alias("group_size"), F.count("*").alias("texts")))
    table = stored(by_digest.select("digest", "keep_id", "group_size", "texts"), "exact_dedup")
    plain = table.filter("texts = 1").select("digest", "keep_id", "group_size", F.col("group_size").alias("rows"))
    out = spread_join(rows.select("id", "digest"), plain, "digest", "rows", F.col("id"))
    if not table.filter("texts > 1").isEmpty():  # different texts of one digest: told apart by the texts themselves
        clash = table.filter("texts > 1").select("digest")
        apart = winner(groups.join(clash, "digest", "left_semi")).withColumnRenamed("n", "group_size")
        own = rows.join(clash, "digest", "left_semi").join(apart, ["digest", "body"])
        out = out.select("id", "digest", "keep_id", "group_size").unionByName(own.select("id", "digest", "keep_id", "group_size"))
    return out.select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


ORACLE_SQL = r"""
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       h AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t,
             sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h
      FROM documents)
WINDOW w AS (PARTITION BY h ORDER BY length(t) DESC, doc_id)
"""
