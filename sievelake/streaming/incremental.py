"""Files that arrive over time, through Structured Streaming: rules on single rows, and copies of rows seen before.

What needs all rows at once (near copies, quotas) stays with the batch operators; this covers what a growing file needs:
each new row is cleaned, given its reason, and appended once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import norm, sha
from ..operators.cascade import first_reason


def new_rows(spark: SparkSession, folder: str, schema: str, fmt: str = "json", files_per_batch: int = 100) -> DataFrame:
    """Rows of files that appear in a folder."""
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files_per_batch).load(folder)


def without_copies(rows: DataFrame, text: str = "text", arrived: str | None = None, late: str = "7 days") -> DataFrame:
    """Rows whose folded text was not seen before; with ``arrived`` (a timestamp), within a bounded memory."""
    keyed = rows.withColumn("__sha", sha(norm(F.col(text))))
    if arrived is None:
        return keyed.dropDuplicates(["__sha"]).drop("__sha")
    return keyed.withWatermark(arrived, late).dropDuplicatesWithinWatermark(["__sha"]).drop("__sha")


def append_filtered(rows: DataFrame, rules: list, kept: str, dropped: str, checkpoint: str) -> StreamingQuery:
    """Append kept and dropped rows (with their reason) to two Parquet folders until no new file is left.

    A batch that is run again after a failure writes to its own subfolder anew, so no row is there twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        marked = batch.withColumn("reason", first_reason(rules))
        marked.filter("reason is null").drop("reason").write.mode("overwrite").parquet(f"{kept}/batch={number}")
        marked.filter("reason is not null").write.mode("overwrite").parquet(f"{dropped}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
