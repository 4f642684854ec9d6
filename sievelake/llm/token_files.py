"""Token-id files: patched frame-of-reference blocks in ascending id order, written and read back.

Layout of a segment (little-endian): ``TIDS``, block length u32, documents u32, ids u64, blocks u32; then the
documents' id counts (u32 each), the block index (u64 each: where the block starts behind the index), and the
blocks.  A block holds BLOCK ids: minimum u32, width u8, number of exceptions u8, the low ``width`` bits of
each (id - minimum), then the exceptions' places (u8 each) and their remaining high bits (u32 each).  The
width is the number of bits that covers the PERCENTILE-th of the block's values; larger ones are exceptions.
The last block is filled up with its last id.

Segments are rows of a Parquet table, because only Spark's own writers reach every shared store and commit
each task's output once, whatever executors are lost: ``part`` and ``seq`` give the order, ``payload`` the
bytes, ``doc_ids`` the identifiers.  Their metadata give each segment's global start without its payload.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import shuffle_parts, slices, texts, values

BLOCK, PERCENTILE = 128, 90
#: A segment ends with the document that brings it to so many ids.
SEGMENT_IDS = 1 << 19
#: So many known words, of at most LONGEST bytes, in a worker before the table starts anew.
KNOWN, LONGEST = 400_000, 64
HEAD = struct.Struct("<4sIIQI")


def bit_lengths(x: np.ndarray) -> np.ndarray:
    return np.frexp(x.astype(np.float64))[1].astype(np.uint8)


def word_type(width: int) -> str:
    """Big-endian integers that hold ``width`` bits: their bits are in the order of a block's."""
    return ">u2" if width <= 16 else ">u4"


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The blocks of ``ids`` (unsigned 32-bit) as bytes, and where each starts."""
    if not ids.size:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint8)
    n = -(-ids.size // BLOCK)
    block = np.concatenate([ids, np.full(n * BLOCK - ids.size, ids[-1], dtype=np.uint32)]).reshape(n, BLOCK)
    low = block.min(axis=1)
    rest = block - low[:, None]
    lengths = bit_lengths(rest)
    width = np.partition(lengths, BLOCK * PERCENTILE // 100, axis=1)[:, BLOCK * PERCENTILE // 100].astype(np.int64)
    odd = lengths > width[:, None]
    count = odd.sum(axis=1)
    size = 6 + BLOCK // 8 * width + 5 * count
    start = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(start[-1], dtype=np.uint8)
    start = start[:-1]
    out[start[:, None] + np.arange(4)] = low.astype("<u4").view(np.uint8).reshape(n, 4)
    out[start + 4], out[start + 5] = width, count
    for w in np.unique(width):
        if not w:
            continue
        for rows in np.array_split(where := np.flatnonzero(width == w), -(-where.size // 512)):
            words = (rest[rows] & np.uint32((1 << w) - 1)).astype(word_type(w))
            bits = np.unpackbits(words.view(np.uint8).reshape(-1, BLOCK, words.itemsize), axis=2)[:, :, 8 * words.itemsize - w :]
            out[start[rows, None] + 6 + np.arange(BLOCK // 8 * w)] = np.packbits(bits.reshape(len(rows), -1), axis=1)
    row, place = np.nonzero(odd)
    nth = np.arange(row.size) - np.repeat(np.cumsum(count) - count, count)
    at = start[row] + 6 + BLOCK // 8 * width[row]
    out[at + nth] = place
    high = (rest[row, place] >> width[row].astype(np.uint32)).astype("<u4").view(np.uint8).reshape(-1, 4)
    out[(at + count[row] + 4 * nth)[:, None] + np.arange(4)] = high
    return start.astype("<u8"), out


def unpack(data: np.ndarray, start: np.ndarray, n_ids: int) -> np.ndarray:
    """The ids of blocks that ``pack`` made; ``start`` may select any of them, in any order."""
    n, start = len(start), start.astype(np.int64)
    low = np.ascontiguousarray(data[start[:, None] + np.arange(4)]).view("<u4").reshape(n)
    width, count = data[start + 4].astype(np.int64), data[start + 5].astype(np.int64)
    rest = np.zeros((n, BLOCK), dtype=np.uint32)
    for w in np.unique(width):
        if not w:
            continue
        for rows in np.array_split(where := np.flatnonzero(width == w), -(-where.size // 512)):
            bits = np.unpackbits(data[start[rows, None] + 6 + np.arange(BLOCK // 8 * w)], axis=1).reshape(-1, BLOCK, w)
            kind = np.dtype(word_type(w))
            full = np.zeros((len(rows), BLOCK, 8 * kind.itemsize), dtype=np.uint8)
            full[:, :, 8 * kind.itemsize - w :] = bits
            rest[rows] = np.packbits(full, axis=2).view(kind).reshape(len(rows), BLOCK)
    row = np.repeat(np.arange(n), count)
    nth = np.arange(row.size) - np.repeat(np.cumsum(count) - count, count)
    at = start[row] + 6 + BLOCK // 8 * width[row]
    place = data[at + nth]
    high = np.ascontiguousarray(data[(at + count[row] + 4 * nth)[:, None] + np.arange(4)]).view("<u4").reshape(-1)
    rest[row, place] |= high << width[row].astype(np.uint32)
    return (rest + low[:, None]).reshape(-1)[:n_ids]


def segment(counts: list[int], ids: np.ndarray) -> bytes:
    start, blocks = pack(ids)
    return HEAD.pack(b"TIDS", BLOCK, len(counts), ids.size, len(start)) + np.array(counts, dtype="<u4").tobytes() + start.tobytes() + blocks.tobytes()


def read_segment(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The documents' id counts, and all ids one after the other."""
    magic, block, docs, n_ids, blocks = HEAD.unpack_from(payload)
    if magic != b"TIDS" or block != BLOCK:
        raise ValueError("not a token-id segment of this format")
    at = HEAD.size
    counts = np.frombuffer(payload, dtype="<u4", count=docs, offset=at)
    start = np.frombuffer(payload, dtype="<u8", count=blocks, offset=at + 4 * docs)
    return counts, unpack(np.frombuffer(payload, dtype=np.uint8, offset=at + 4 * docs + 8 * blocks), start, n_ids)


#: A word of letters that are one code point in form C and lower to one, and, behind them, signs that no rule of the
#: pre-tokenizer joins with letters. Letters beyond Latin-1 go through the whole encoder.
SIMPLE = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([^A-Za-z0-9'<\x80-\U0010ffff]*)").fullmatch
#: How byte-level vocabularies write bytes: printable Latin-1 ones as themselves, all others from U+0100 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
AS_LETTERS = {b: chr(b) for b in _SHOWN} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}


class WordIds(dict):
    """Ids of texts by the public library, a known word at a time: a table from words to ids that learns those it misses.

    For tokenizers that lower their text and whose normaliser and pre-tokenizer never join what ASCII white space parts
    (the words' ids one after the other are then the text's).  A new word goes through the library: plain
    letters straight to its model (its normaliser only lowers them, its pre-tokenizer keeps them whole), all else
    through the whole encoder.  The table starts anew when it's full.
    """

    def __init__(self, definition: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenize = self.tokenizer.model.tokenize
        self.code = "H" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "I"

    def __missing__(self, word: bytes) -> bytes:
        simple = SIMPLE(word.decode())
        if simple is None:
            ids = array(self.code, self.tokenizer.encode(word.decode(), add_special_tokens=False).ids).tobytes()
        elif simple[2]:
            ids = self[simple[1].lower().encode()] + self[simple[2].encode()]
        else:
            low = simple[1].lower()
            shown = low if low.isascii() else low.encode().decode("latin-1").translate(AS_LETTERS)
            ids = array(self.code, [t.id for t in self.tokenize(shown)]).tobytes()
        if len(word) <= LONGEST:
            self[word] = ids
        return ids

    def __call__(self, text: str) -> np.ndarray:
        if len(self) > KNOWN:
            self.clear()
        raw = text.encode()
        if b"<" not in raw:  # special tokens, which lowering could make, begin with it
            raw = raw.lower()
        return np.frombuffer(b"".join(map(self.__getitem__, raw.split())), dtype=self.code)  # split at ASCII white space alone


@cache
def word_ids(definition: str) -> WordIds:
    """One for each worker process and tokenizer: later tasks start with what earlier ones learned."""
    return WordIds(definition)


def write_token_files(df: DataFrame, tokenizer_path: str, path: str, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode all texts and write their ids, in ascending ``id_col`` order, as segments under ``path``.

    ``end_id`` is appended to each document.  The rows are dealt by ranges of ``id_col`` (one shuffle of the
    texts), encoded where they land and written at once.  Null ids come first; rows with equal ids
    stand in the order of their texts; null and empty texts have the end id alone (or no id).
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        definition = df.sparkSession.sparkContext.broadcast(f.read())
    kind = df.schema[id_col].dataType.simpleString()
    end = np.array([] if end_id is None else [end_id], dtype=np.uint32)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, seq = word_ids(definition.value), TaskContext.get().partitionId(), 0
        names, held, total = [], [], 0

        def flush() -> pa.RecordBatch:
            counts = [x.size for x in held]
            payload = segment(counts, np.concatenate(held))
            return pa.RecordBatch.from_arrays([pa.array([x], type=t) for x, t in ((part, pa.int32()), (seq, pa.int32()), (sum(counts), pa.int64()), (names, pa.list_(ids_type)), (payload, pa.binary()))], names=["part", "seq", "n_ids", "doc_ids", "payload"])

        for batch in slices(batches, text_col):
            ids_type = batch.schema.field(id_col).type
            for name, text in zip(values(batch, id_col), texts(batch, text_col)):
                names.append(name)
                held.append(np.concatenate([words(text), end]))
                total += held[-1].size
                if total >= SEGMENT_IDS:
                    yield flush()
                    names, held, total, seq = [], [], 0, seq + 1
        if names:
            yield flush()

    dealt = df.select(id_col, text_col).repartitionByRange(shuffle_parts(df.sparkSession), id_col).sortWithinPartitions(id_col, text_col)
    dealt.mapInArrow(encode, f"part int, seq int, n_ids bigint, doc_ids array<{kind}>, payload binary").write.parquet(path)


def read_token_files(spark: SparkSession, path: str, id_col: str = "doc_id", keep: tuple[str, ...] = ("ids",)) -> DataFrame:
    """One row a document, from the files: ``id_col``, ``start`` (ids of all documents before it), ``n_tokens``,
    and of ``ids`` (binary, little-endian unsigned 32-bit) and ``ids_crc32`` those in ``keep``.

    Rows that were written repeatedly come back as often, null ids as null; files of an empty table give no row.
    """
    table = spark.read.parquet(path)
    kind = table.schema["doc_ids"].dataType.elementType.simpleString()
    kinds = {"ids": "binary", "ids_crc32": "bigint"}
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    # Two steps: the sum over the parts is as long as the number of tasks that wrote, not of segments.
    parts = table.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before.orderBy("part")), F.lit(0)).alias("part_start"))
    starts = table.select("part", "seq", F.coalesce(F.sum("n_ids").over(before.partitionBy("part").orderBy("seq")), F.lit(0)).alias("in_part")).join(parts, "part")
    starts = starts.select("part", "seq", (F.col("part_start") + F.col("in_part")).alias("segment_start"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, names, payload in zip(*(values(batch, c) for c in ("part", "seq", "doc_ids", "payload"))):
                counts, ids = read_segment(payload)
                ends = np.cumsum(counts, dtype=np.int64)
                raw, begins = ids.astype("<u4").tobytes(), ends - counts
                cut = [raw[4 * a : 4 * b] for a, b in zip(begins.tolist(), ends.tolist())]
                columns = [pa.array(names, type=batch.schema.field("doc_ids").type.value_type), pa.array([part] * len(names), pa.int32()), pa.array([seq] * len(names), pa.int32()), pa.array(begins), pa.array(counts.astype(np.int64))]
                columns += [pa.array(cut, pa.binary()) if k == "ids" else pa.array([zlib.crc32(x) for x in cut], pa.int64()) for k in keep]
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "part", "seq", "begin", "n_tokens", *keep])

    rows = table.select("part", "seq", "doc_ids", "payload").mapInArrow(decode, ", ".join([f"`{id_col}` {kind}", "part int, seq int, begin bigint, n_tokens bigint", *(f"{k} {kinds[k]}" for k in keep)]))
    return rows.join(starts, ["part", "seq"]).select(id_col, (F.col("segment_start") + F.col("begin")).alias("start"), "n_tokens", *keep)
