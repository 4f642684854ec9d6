"""Cutting the lineage of iterative operators (a written table in the folder that all executors share), and numbering rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path under ``spark.checkpoint.dir``; a local session without that setting gets a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="sievelake-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/sievelake/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet where all executors see it, and read it back."""
    path = path or shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a path of any store that Spark reaches."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def numbered(df: DataFrame, name: str = "n") -> DataFrame:
    """Rows numbered from 1 in the order they come in, by offsets of partitions: no single task holds all rows.

    The rows are stored first, so that both uses of them see the same partitions.
    """
    df = stored(df.withColumn("__i", F.monotonically_increasing_id()), "numbered").withColumn("__p", F.shiftright("__i", 33))
    sizes = df.groupBy("__p").agg(F.count("*").alias("__c"), F.min("__i").alias("__first"))
    before = F.coalesce(F.sum("__c").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.withColumn("__before", before)
    # As many rows as the input had partitions.
    return df.join(F.broadcast(sizes), "__p").withColumn(name, F.col("__before") + F.col("__i") - F.col("__first") + 1).drop("__p", "__i", "__c", "__first", "__before")


def numbered_by(df: DataFrame, *order: Column | str, name: str = "n") -> DataFrame:
    """Rows numbered from 1 in the order of columns: dealt by ranges, sorted inside each."""
    return numbered(df.repartitionByRange(*order).sortWithinPartitions(*order), name)
