"""Helpers that several operators need: shared storage, Arrow batches, seeded hashing in plain columns."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from decimal import Decimal

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six characters that every contract calls white space: tab to carriage return, and the blank.
BLANKS = r"[\x20\x09-\x0D]"
NOT_BLANKS = r"[^\x20\x09-\x0D]+"
#: Rows are handed to Python code in slices of about so many bytes of text, however long the texts are.
SLICE_BYTES = 8 << 20
#: A key with more rows than this, and than one in MOST_HOT of all rows, is hot: its rows are salted before a join.
HOT_ROWS, MOST_HOT = 1000, 2000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Unset, a temporary folder serves in local mode (tests); on a cluster that's an error, because
    executors could not see the driver's local disk.
    """
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="sievelake-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage: a lost executor costs the tasks it ran, not the stages before the table.
    """
    path = f"{shared_dir(df.sparkSession)}/sievelake/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Stored tables of one operator that nothing needs once its result is stored: ``drop`` deletes them together."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.path = spark, f"{shared_dir(spark)}/sievelake/{label}-{uuid.uuid4().hex}"

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each has about ``most`` bytes of text (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
        start = held = 0
        for i, n in enumerate(sizes):
            if held and held + n > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        yield batch.slice(start)


def trim() -> None:
    """Give memory that a task no longer uses back to the system: the next task's worker is the same process."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library than glibc
        pass


def arrow_map(df: DataFrame, work: Callable[[pa.RecordBatch], dict], schema: str, text: str, most: int = SLICE_BYTES) -> DataFrame:
    """``mapInArrow`` over slices of ``most`` bytes; ``work`` turns a slice into columns named as in ``schema``.

    ``work`` may be a class with a ``__call__``: a ``start()`` method, if any, runs once a task.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if hasattr(work, "start"):
            work.start()
        for part in slices(batches, text, most):
            columns = work(part)
            yield pa.RecordBatch.from_arrays([c if isinstance(c := columns[f.name], pa.Array) and c.type == f.type else pa.array(c, type=f.type) for f in arrow], schema=arrow)
        trim()

    return df.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, name: str) -> list[str]:
    """A column of texts with null as the empty text."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def values(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row, however often ``body`` names it inside its own lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def whole(n: int) -> Column:
    """A literal of any size: a decimal without fraction."""
    return F.lit(Decimal(n))


def unit_random(seed: int, *columns: Column) -> Column:
    """A number inside (0, 1) that depends on the seed and the columns alone."""
    return (F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))


def id_bounds(df: DataFrame, key: str, parts: int) -> list:
    """At most ``parts - 1`` values of ``key`` that cut the rows into parts of about equal size.

    One aggregation over the key column alone: the texts are not read for it.
    """
    if parts < 2:
        return []
    cuts = [i / parts for i in range(1, parts)]
    row = df.agg(F.percentile_approx(F.col(key), cuts, 20_000).alias("cuts")).first()
    return sorted(set(row["cuts"] or []))


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt out over all cores where a small input comes in fewer partitions than there are; larger ones stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores behind it until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def spread_join(rows: DataFrame, table: DataFrame, key: str, count: str, salt: Column, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``table``, which has one row for each ``key`` and, in ``count``, how many rows have it.

    Rows of hot keys (at most MOST_HOT, by their definition) are dealt over several tasks by ``salt``, a column of theirs, and
    the table's row for such a key is copied as often.  ``table`` is read several times: a stored one, or a cheap one.
    """
    seen = table.agg(F.sum(count).alias("total"), F.max(count).alias("most")).first()
    limit = max(HOT_ROWS, (seen["total"] or 0) // MOST_HOT)
    if (seen["most"] or 0) <= limit:
        return rows.join(table.drop(count), key, how)
    salts, hot_key, hot_salts, salted = F.ceil(F.col(count) / limit).cast("int"), unused(rows, "__hot"), unused(rows, "__salts"), unused(rows, "__salt")
    hot = table.filter(F.col(count) > limit).select(F.col(key).alias(hot_key), salts.alias(hot_salts))
    own = rows.join(F.broadcast(hot), F.col(key) == F.col(hot_key), "left")
    own = own.withColumn(salted, F.coalesce(F.pmod(F.xxhash64(salt), F.col(hot_salts)).cast("int"), F.lit(0))).drop(hot_key, hot_salts)
    many = table.withColumn(salted, F.explode(F.sequence(F.lit(0), F.when(F.col(count) > limit, salts - 1).otherwise(0)))).drop(count)
    return own.join(many, [key, salted], how).drop(salted)
