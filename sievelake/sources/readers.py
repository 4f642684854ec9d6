"""Typed scans of JSONL, CSV, delimited text, nested JSON and id lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import strip
from ..operators.storage import numbered


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether any store that Spark reaches has the path (globs allowed)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def first_existing(spark: SparkSession, candidates: list[str], excludes: tuple[str, ...] = ()) -> str | None:
    """The first path, by candidate (globs allowed) and then by name, that exists and has none of ``excludes`` in its file name."""
    for candidate in candidates:
        p = spark._jvm.org.apache.hadoop.fs.Path(candidate)
        found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
        names = sorted(f.getPath().toString() for f in found) if found is not None else []
        for name in names:
            if not any(x in name.rsplit("/", 1)[-1] for x in excludes):
                return name
    return None


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One object a line; blank lines are skipped, a missing file is an empty table, a malformed line fails.

    Only line feeds part records, so texts may hold U+2028 and the like unescaped.
    """
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("lineSep", "\n").option("mode", "FAILFAST").json(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, empty where nothing stands; fields may hold quotes (doubled) and line ends; a byte order mark is dropped."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("nullValue", "").option("emptyValue", "").csv(path)
    first = df.columns[0]
    df = df.withColumnRenamed(first, first.lstrip("\ufeff")) if first.startswith("\ufeff") else df
    return df.select(*(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in df.columns))


def read_eval_csv(spark: SparkSession, path: str) -> DataFrame:
    """(eval_index, eval_id, task, prompt) of an evaluation file: header names are trimmed and lowered, ids default to E01,
    E02 ... by row (blank prompts count), blank prompts are left out."""
    df = read_csv(spark, path)
    names = {c.strip().lower(): c for c in df.columns}
    if "prompt" not in names:
        raise ValueError(f"{path} needs a column named 'prompt'")
    ident, task = names.get("eval_id") or names.get("id"), names.get("task")
    rows = numbered(df.select(strip(F.coalesce(F.col(f"`{names['prompt']}`"), F.lit(""))).alias("prompt"), (F.col(f"`{ident}`") if ident else F.lit(None).cast("string")).alias("own"), (F.col(f"`{task}`") if task else F.lit(None).cast("string")).alias("task")))
    return eval_rows(rows)


def read_eval_text(spark: SparkSession, path: str) -> DataFrame:
    """The same of a plain text: prompts between lines of three or more dashes, or else one a line."""
    whole = spark.read.text(path, wholetext=True)
    dashed = F.split("value", r"(?m)^-{3,}\s*$", -1)
    parts = F.when(F.size(dashed) > 1, dashed).otherwise(F.split("value", r"\R", -1))
    kept = F.filter(F.transform(parts, strip), lambda p: p != "")
    rows = whole.select(F.posexplode(kept).alias("p", "prompt")).select((F.col("p") + 1).alias("n"), "prompt", F.lit(None).cast("string").alias("own"), F.lit(None).cast("string").alias("task"))
    return eval_rows(rows)


def eval_rows(rows: DataFrame) -> DataFrame:
    """``rows``: n (from 1), own (id or null), task, prompt."""
    ident = strip(F.coalesce(F.when(F.col("own") != "", F.col("own")), F.concat(F.lit("E"), F.lpad(F.col("n").cast("string"), F.greatest(F.lit(2), F.length(F.col("n").cast("string"))), F.lit("0")))))
    return rows.filter(F.col("prompt") != "").select((F.col("n") - 1).alias("eval_index"), ident.alias("eval_id"), "task", "prompt")


def require_rows(df: DataFrame, expected: int) -> DataFrame:
    """``df``, unless it hasn't exactly the expected number of rows."""
    n = df.limit(expected + 1).count()
    if n != expected:
        raise ValueError(f"expected {expected} rows, found {n if n <= expected else f'more than {expected}'}")
    return df


def require_columns(df: DataFrame, columns: set[str]) -> DataFrame:
    missing = columns - set(df.columns)
    if missing:
        raise ValueError(f"columns are missing: {sorted(missing)}")
    return df


def same_ids_in_order(a: DataFrame, b: DataFrame, key: str = "eval_id") -> bool:
    """Whether two files list the same ids in the same order."""
    left, right = numbered(a.select(key)), numbered(b.select(F.col(key).alias("other")))
    return left.join(right, "n", "full").filter(~F.col(key).eqNullSafe(F.col("other"))).isEmpty()


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the list ``results`` of a nested JSON document."""
    return spark.read.option("multiLine", True).json(path).select(F.explode("results").alias("r")).select("r.*")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """One id a line; a missing file is no ids."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], "id string")
    return spark.read.text(path).select(F.col("value").alias("id")).filter("id <> ''")
