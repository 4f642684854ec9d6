"""Document fingerprints: a canonical exact digest.

A text's canonical form is NFKC, case-folded, NFKC again, with each run of white space as one blank and none at the
ends; its fingerprint is the 128-bit xxhash (XXH3) of that form in UTF-8.  Texts that differ only in such
respects share a fingerprint; ``group`` puts documents with one fingerprint together and compares the canonical bytes
inside each bucket, so that different forms never count as one, whatever the hash.

Between two fingerprints the likeness is 1 or 0: this digest says equal or different, not how much.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import arrow_map, id_bounds, shuffle_parts, slices, spread_join, stored, texts, trim, values


def canonical(text: str) -> bytes:
    if text.isascii():
        return " ".join(text.lower().split()).encode()
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(folded.split()).encode()


def digest(form: bytes) -> str:
    return xxhash.xxh3_128_hexdigest(form)


class _Fingerprint:
    def __init__(self, text_col: str, hashed: Callable[[bytes], str]):
        self.text_col, self.hashed = text_col, hashed

    def __call__(self, batch: pa.RecordBatch) -> dict:
        forms = [canonical(t) for t in texts(batch, self.text_col)]
        return {"id": values(batch, "id"), "fingerprint": [self.hashed(f) for f in forms], "form": forms}


def fingerprint(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", hashed: Callable[[bytes], str] = digest) -> DataFrame:
    """``id``, ``fingerprint`` and ``form`` (the canonical bytes) of each row; null counts as the empty text."""
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return arrow_map(rows, _Fingerprint("text", hashed), f"id {kind}, fingerprint string, form binary", "text")


def group(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", hashed: Callable[[bytes], str] = digest) -> DataFrame:
    """``fingerprint``, ``variant``, ``first_id`` (smallest id), ``group_size``, ``form_sha256``: one row for each canonical form.

    Forms are combined inside each task first, with their bytes in the key, then globally, so a task sends a form
    once and a large group of copies is never in one place.  ``variant`` is 0, and above only for a further
    form in an equal bucket (numbered by first id): the pair of fingerprint and variant stands for one form.
    """
    forms = fingerprint(df, id_col, text_col, hashed).groupBy("fingerprint", "form").agg(F.min("id").alias("first_id"), F.count("*").alias("group_size"))
    order = Window.partitionBy("fingerprint").orderBy("first_id", "form_sha256")
    table = forms.select("fingerprint", F.sha2("form", 256).alias("form_sha256"), "first_id", "group_size")
    return stored(table.withColumn("variant", F.row_number().over(order) - 1), "fingerprint_groups")


def edited(text: str, other: str) -> str:
    """The text with its last half (rounded down) replaced by as many characters from the other's start."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


def compare_with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", hashed: Callable[[bytes], str] = digest) -> DataFrame:
    """Each document against the next in ascending ``id_col`` order (after the last, the first) and against its
    own edited text: ``id_col``, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``,
    ``near_edited``, ``near_next`` (1.0 if the canonical bytes are equal, else 0.0), ``form_sha256`` (of its canonical bytes).
    Ids are numbers.

    The rows are dealt by ranges of the id, and the first document of each range also goes, marked, behind
    the range before it, so that each task holds every next document.  The texts are shuffled once, compressed.
    Null ids come first; rows with equal ids stand in the order of their texts.  Null counts as the empty text.
    A single row is its own next.  Empty table: empty result.
    """
    spark = df.sparkSession
    kind = df.schema[id_col].dataType.simpleString()
    parts = shuffle_parts(spark)
    bounds = id_bounds(df, id_col, parts)
    bucket = F.lit(0)
    if bounds:  # the number of bounds that the id has reached, by halving; the running number is a variable, not a copy
        steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
        reached = lambda n, step: F.get(F.lit(bounds), n + step - 1) <= F.col(id_col)
        bucket = F.aggregate(F.lit(steps), F.lit(0), lambda n, step: n + F.when(reached(n, step), step).otherwise(0))
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), bucket.alias("bucket"))
    # First of each bucket, by (id, text): one small row a bucket, with the length of no text but its own.
    heads = rows.select("bucket", "id").groupBy("bucket").agg(F.min("id").alias("first"), F.max(F.col("id").isNull()).alias("has_null"))
    found = sorted(heads.collect(), key=lambda r: r["bucket"])
    if not found:
        return rows.select("id").limit(0).selectExpr(f"id AS `{id_col}`", "0L AS n_chars", "'' AS edited_sha256", "'' AS fingerprint", "'' AS edited_fingerprint", "0D AS near_edited", "0D AS near_next", "'' AS form_sha256")
    own = [r["bucket"] for r in found]
    before = dict(zip(own, [own[-1], *own[:-1]]))
    heads_of = {r["bucket"]: None if r["has_null"] else r["first"] for r in found}
    lookup = spark.createDataFrame([(b, heads_of[b], before[b]) for b in own], f"bucket int, first {kind}, to int")

    class Pack:
        def __call__(self, batch: pa.RecordBatch) -> dict:
            small = zstandard.ZstdCompressor(level=3)
            return {"id": values(batch, "id"), "bucket": values(batch, "bucket"), "extra": values(batch, "extra"), "text": [small.compress(t.encode()) for t in texts(batch, "text")]}

    both = rows.withColumn("extra", F.lit(False)).join(F.broadcast(lookup), "bucket")
    copies = F.array(F.struct(F.col("bucket"), F.lit(False).alias("extra")), F.when(F.col("id").eqNullSafe(F.col("first")), F.struct(F.col("to").alias("bucket"), F.lit(True).alias("extra"))))
    both = both.select("id", "text", F.explode(F.filter(copies, lambda c: c.isNotNull())).alias("c")).select("id", "text", "c.bucket", "c.extra")
    packed = arrow_map(both, Pack(), f"id {kind}, bucket int, extra boolean, text binary", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        names = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "form_sha256"]
        held = None  # (bucket, id, text, form) of the row before
        last_bucket_done = None

        def result(row, other_text: str, other_form: bytes) -> tuple:
            _, name, text, form = row
            new = edited(text, other_text)
            new_form = canonical(new)
            return name, len(text), hashlib.sha256(new.encode()).hexdigest(), hashed(form), hashed(new_form), float(form == new_form), float(form == other_form), hashlib.sha256(form).hexdigest()

        for batch in slices(batches, "text"):
            out = []
            for bucket, name, extra, data in zip(*(values(batch, c) for c in ("bucket", "id", "extra", "text"))):
                if extra and last_bucket_done == bucket:
                    continue  # further rows that share the next range's first id: only the first of them is next
                text = unpack.decompress(data).decode()
                form = canonical(text)
                if held is not None and held[0] == bucket:
                    out.append(result(held, text, form))
                held = (bucket, name, text, form)
                if extra:
                    last_bucket_done, held = bucket, None
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out), (batch.schema.field("id").type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.string()))], names=names)

    # Inside a bucket the marked rows come last; equal ids stand in the order of a digest of their texts, which
    # is the same for the rows and for their marked copies.
    dealt = packed.repartitionById(parts, F.col("bucket")).sortWithinPartitions("bucket", "extra", F.col("id").asc_nulls_first(), F.sha2("text", 256))
    return dealt.mapInArrow(work, f"`{id_col}` {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, form_sha256 string")


def fingerprint_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", hashed: Callable[[bytes], str] = digest) -> DataFrame:
    """``compare_with_next`` with ``first_id`` and ``group_size`` of each document's group of equal canonical forms.

    If an equal bucket holds different forms, the fingerprints of all but the first of them get ``-variant`` behind.
    Rows that share an id, and rows without one, come out as often as they are.  Rows of large groups are salted to meet theirs.
    """
    groups = group(df, id_col, text_col, hashed).withColumn("rows", F.col("group_size"))
    out = spread_join(compare_with_next(df, id_col, text_col, hashed), groups.drop("fingerprint"), "form_sha256", "rows", F.col(id_col))
    named = F.when(F.col("variant") > 0, F.concat_ws("-", "fingerprint", F.col("variant").cast("string"))).otherwise(F.col("fingerprint"))
    return out.withColumn("fingerprint", named).drop("variant", "form_sha256")
