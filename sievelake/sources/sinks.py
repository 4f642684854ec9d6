"""Writers: a dataset is replaced only when all of the new one is written, rows are appended, reports put in place."""

from __future__ import annotations

import io
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Task names in the pipeline and in the evaluation's files.
TASK_NAMES = {"knowledge": "closed_book_knowledge", "comprehension": "instruction_following", "translation": "translation", "summarisation": "summarization"}


def replace(df: DataFrame, path: str, fmt: str = "json", **options) -> None:
    """Write beside ``path``, then move the old dataset aside and the new one into its place.

    The old one is deleted last.  What a crash between the two moves leaves aside, ``recover`` or the next call puts back.
    """
    spark = df.sparkSession
    recover(spark, path)
    place = path.rstrip("/")
    staged = f"{place}.{uuid.uuid4().hex}"
    df.write.format(fmt).options(**options).save(staged)
    at = spark._jvm.org.apache.hadoop.fs.Path
    new, old, aside = at(staged), at(place), at(f"{place}.before")
    fs = new.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(old) and not fs.rename(old, aside):
        raise OSError(f"{place} couldn't be moved aside")
    if not fs.rename(new, old):
        recover(spark, path)
        raise OSError(f"{staged} couldn't be moved to {place}")
    fs.delete(aside, True)


def recover(spark: SparkSession, path: str) -> None:
    """Put a dataset back that a replacement has moved aside without ending; delete what it left if it has ended."""
    place = path.rstrip("/")
    at = spark._jvm.org.apache.hadoop.fs.Path
    old, aside = at(place), at(f"{place}.before")
    fs = old.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(aside):
        if fs.exists(old):
            fs.delete(aside, True)
        else:
            fs.rename(aside, old)


def append(df: DataFrame, path: str, fmt: str = "json") -> None:
    df.write.format(fmt).mode("append").save(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Fields keep white space and control characters at their ends, which Spark's writer would trim."""
    replace(df, path, "csv", header=True, escape='"', emptyValue="", nullValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """A small document as one file, in whatever store the path is."""
    put_bytes(spark, path, text.encode())


def put_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


#: Bytes that a bundle's files have at most together: the driver holds them.
MOST_BUNDLE_BYTES = 256 << 20


def bundle(spark: SparkSession, folder: str, target: str) -> None:
    """All files under ``folder`` (reports, tables, small models) in one zip file, which must be elsewhere."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    if (files.agg(F.sum("length")).first()[0] or 0) > MOST_BUNDLE_BYTES:
        raise ValueError(f"{folder} is too large for a bundle")
    held = io.BytesIO()
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    base = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toUri().getPath().rstrip("/") + "/"
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for r in sorted(files.select("path", "content").collect(), key=lambda r: r["path"]):
            z.writestr(r["path"].split(base, 1)[1], bytes(r["content"]))
    put_bytes(spark, target, held.getvalue())


def task_name(task: Column) -> Column:
    return F.create_map(*(F.lit(x) for kv in TASK_NAMES.items() for x in kv))[task]


def chat_format(df: DataFrame, meta: tuple[str, ...]) -> DataFrame:
    """``messages`` (a user's and an assistant's turn) and ``meta`` of prompt and response rows."""
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), F.col(c).alias("content"))
    return df.select(F.array(turn("user", "prompt"), turn("assistant", "response")).alias("messages"), F.struct(*meta).alias("meta"))


def submission(df: DataFrame) -> DataFrame:
    """The four columns of a training file, with the evaluation's task names and where prompt and answer come from."""
    source = F.concat(F.lit("synthetic|prompts:"), "prompt_writer", F.lit("|answers:"), "teacher")
    return df.select("prompt", F.col("response").alias("teacher_response"), task_name(F.col("task")).alias("task"), source.alias("source"))


FULL = ("id", "task", "direction", "domain", "subtopic", "template_id", "prompt", "teacher_response", "prompt_tokens", "answer_tokens", "judge_scores", "teacher", "prompt_writer")


def full_table(df: DataFrame) -> DataFrame:
    """The thirteen columns of the full training file; no direction is an empty text, scores are JSON."""
    out = df.withColumn("direction", F.coalesce("direction", F.lit(""))).withColumn("teacher_response", F.col("response"))
    return out.withColumn("judge_scores", F.coalesce(F.to_json("scores"), F.lit("null"))).select(*FULL)


def review_sheet(df: DataFrame, columns: list[str], blanks: list[str]) -> DataFrame:
    """Columns to read and empty ones to fill in."""
    return df.select(*columns, *(F.lit("").alias(b) for b in blanks))
