"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1 that depends on its code point alone; any run of other characters
counts as one separator with a vector of its own.  A trigram's vector binds its three letters' vectors,
permuted (rotated) by their place: ``rot2(a) * rot1(b) * c``.  A text's vector bundles (adds) those of its
trigrams, a language's prototype those of all its training texts, and a text gets the language
whose prototype has the highest cosine with it.

Training sums prototypes: a slice of rows sends one vector a language, so what is shuffled doesn't depend on the
vocabulary, and the model is a few kB a language.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import arrow_map, texts, values

DIMENSIONS = 1024
UNKNOWN = "und"
#: More languages than this in the training rows are refused: the prototypes are sent to every worker.
MOST_LANGUAGES = 2000
#: Trigrams and documents that are multiplied at a time.
TRIGRAMS, DOCUMENTS = 2048, 512


@cache
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


class Space:
    """The letter vectors met so far, in ``dims`` dimensions, and their bindings."""

    def __init__(self, dims: int):
        self.dims = dims
        self.place = np.full(0x110000, -1, dtype=np.int32)
        self.vectors = np.zeros((0, dims), dtype=np.int8)

    def rows(self, symbols: np.ndarray) -> np.ndarray:
        new = np.unique(symbols[self.place[symbols] < 0])
        if new.size:
            bits = np.stack([np.random.Generator(np.random.Philox(key=int(c) + 1)).integers(0, 2, self.dims, dtype=np.int8) for c in new])
            self.place[new] = np.arange(len(self.vectors), len(self.vectors) + new.size)
            self.vectors = np.concatenate([self.vectors, 2 * bits - 1])
        return self.vectors[self.place[symbols]]

    def bind(self, codes: np.ndarray) -> np.ndarray:
        a, b, c = (self.rows(((codes >> s) & 0x1FFFFF).astype(np.int64)) for s in (42, 21, 0))
        return (np.roll(a, 2, axis=1) * np.roll(b, 1, axis=1) * c).astype(np.float32)


@cache
def space(dims: int) -> Space:
    return Space(dims)


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigrams (three code points of 21 bits; 0: separator) and their counts; none without letters."""
    symbol = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    symbol = np.where(letters()[symbol], symbol, 0)
    symbol = np.concatenate([[0], symbol, [0]])
    symbol = symbol[np.append(True, (symbol[1:] != 0) | (symbol[:-1] != 0))]
    if symbol.size < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.unique(symbol[:-2] << 42 | symbol[1:-1] << 21 | symbol[2:], return_counts=True)


def bundle(found: list[tuple[np.ndarray, np.ndarray]], group: np.ndarray, n: int, dims: int) -> np.ndarray:
    """Sum of the trigram vectors of each of ``n`` groups of texts."""
    out = np.zeros((n, dims))
    sizes = [len(c) for c, _ in found]
    if not sum(sizes):
        return out
    codes, at = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
    counts, row = np.concatenate([k for _, k in found]), np.repeat(group, sizes)
    order = np.argsort(at, kind="stable")
    codes_at, counts, row = at[order], counts[order], row[order]
    for start in range(0, codes.size, TRIGRAMS):
        a, b = np.searchsorted(codes_at, [start, start + TRIGRAMS])
        vectors = space(dims).bind(codes[start : start + TRIGRAMS])
        dense = np.zeros((n, len(vectors)), dtype=np.float32)
        np.add.at(dense, (row[a:b], codes_at[a:b] - start), counts[a:b])
        out += dense @ vectors
    return out


class _Train:
    def __init__(self, text_col: str, lang_col: str, dims: int):
        self.text_col, self.lang_col, self.dims = text_col, lang_col, dims

    def __call__(self, batch: pa.RecordBatch) -> dict:
        names, group = np.unique(np.array(values(batch, self.lang_col), dtype=object), return_inverse=True)
        sums = bundle([trigrams(t) for t in texts(batch, self.text_col)], group, len(names), self.dims)
        return {"lang": names.tolist(), "vector": [v.astype("<f8").tobytes() for v in sums]}


def train(df: DataFrame, text_col: str = "text", lang_col: str = "lang", dims: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """Prototypes of the languages in ``lang_col``; rows without language or text count for nothing."""

    def add(table: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(v.as_py(), dtype="<f8") for v in table["vector"]], axis=0)
        return pa.table({"lang": table["lang"][:1].cast(pa.string()), "vector": pa.array([total.astype("<f8").tobytes()], pa.binary())})

    rows = df.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(text_col, lang_col)
    parts = arrow_map(rows, _Train(text_col, lang_col, dims), "lang string, vector binary", text_col)
    salted = parts.withColumn("salt", F.spark_partition_id() % 32).groupBy("lang", "salt").applyInArrow(add, "lang string, vector binary")
    found = salted.groupBy("lang").applyInArrow(add, "lang string, vector binary").limit(MOST_LANGUAGES + 1).collect()
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} languages in {lang_col}")
    return {r["lang"]: np.frombuffer(r["vector"], dtype="<f8") for r in sorted(found, key=lambda r: r["lang"])}


class _Predict:
    def __init__(self, keep: tuple[str, ...], text_col: str, named: tuple[str, ...], names: list[str], prototypes: np.ndarray):
        self.keep, self.text_col, self.named, self.names, self.prototypes = keep, text_col, named, names, prototypes

    def __call__(self, batch: pa.RecordBatch) -> dict:
        found = [trigrams(t) for t in texts(batch, self.text_col)]
        langs, scores = [], []
        for start in range(0, len(found), DOCUMENTS):
            part = found[start : start + DOCUMENTS]
            vectors = bundle(part, np.arange(len(part)), len(part), self.prototypes.shape[1])
            length = np.linalg.norm(vectors, axis=1)
            cosine = vectors @ self.prototypes.T / np.where(length > 0, length, 1)[:, None]
            for (codes, _), row in zip(part, cosine):
                known = codes.size and self.names
                langs.append(self.names[int(row.argmax())] if known else UNKNOWN)
                scores.append(min(1.0, max(0.0, float(row.max()))) if known else 0.0)
        found = zip(self.named, (langs, scores, [codes.size for codes, _ in found]))
        return {**{c: batch.column(batch.schema.get_field_index(c)) for c in self.keep}, **dict(found)}


def predict(df: DataFrame, prototypes: dict[str, np.ndarray], keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", named: tuple[str, ...] = ("lang_pred", "score")) -> DataFrame:
    """The columns ``keep``, ``lang_pred`` and ``score`` (the cosine, 0 at least) of every row; the text is the only input.
    ``named`` gives these two other names; a third name is a column for the number of distinct trigrams that the score rests on.  A
    kept column that has one of these names gives way.

    A null text, or one without a letter, is ``und`` with score 0, and so is every text if there are no
    prototypes (an empty training table).  Equal cosines go to the first language by code point.
    Repeated rows come out repeated; no shuffle.
    """
    lengths = {k: float(np.linalg.norm(v)) for k, v in prototypes.items()}
    names = [k for k in prototypes if lengths[k] > 0]
    matrix = np.stack([prototypes[k] / lengths[k] for k in names]) if names else np.zeros((1, DIMENSIONS))
    keep = tuple(c for c in keep if c not in named)
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), *(f"`{c}` {t}" for c, t in zip(named, ("string", "double", "bigint")))])
    return arrow_map(df.select(*dict.fromkeys([*keep, text_col])), _Predict(keep, text_col, named, names, matrix), schema, text_col)


def fold(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n`` (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % n
