"""Scoring with a Brown class-based bigram model.

``log10 P(text) = sum over tokens of log10 P(class | class before) + log10 P(word | class)``, the end being a token.

Classes come from exchange clustering in two steps.  The CLUSTERED most frequent words are moved one at a time to the
class that gives the training text the highest class-bigram likelihood, until a pass over them moves none.  Then each
further word of the BROADCAST most frequent goes to the class that it raises the likelihood of most, given how often it stands
before and behind each class; every word does so by itself, so that step runs in parallel over the words.  Words beyond
these share classes by shape (length, and whether they have digits, signs or non-ASCII letters), and the end is a
class of its own.  At last the class bigrams of all tokens are counted.  So the tables that workers hold and the
driver gets have a fixed bound, and every token of every text counts in them.

Word counts grow with the corpus.  The most frequent words, at most BROADCAST, go to every worker; for all
others a text yields its rare words, which meet their counts in a join.  A text's score is a sum, so the part that needs
no look-up (all transitions, the frequent words) is taken in one pass and the rest added by row.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import arrow_map, slices, stored, texts, trim, values

CLUSTERED, CLASSES = 2048, 48
BROADCAST = 1 << 17
SHAPES = 16
#: Added to each word's count in its class, and to each class transition.
WORD_PRIOR, CLASS_PRIOR = 0.5, 0.1
#: The end of a text as a word: no word has a blank.
END = b" "
#: Words counted in a task before they are sent on, and words placed at a time.
FLUSH, BLOCK = 200_000, 1024


def tokens(text: str) -> list[bytes]:
    """Words of a text, A-Z lowered, parted at ASCII white space."""
    return text.encode().lower().split()


def shape(word: bytes) -> int:
    length = min(3, len(word) // 4)
    kind = 3 if not word.isascii() else 0 if word.isalpha() else 1 if word.isalnum() else 2
    return 4 * length + kind


class Units(dict):
    """Number of each word: that of ``numbers``, else ``base + shape``, remembered up to a bound."""

    def __init__(self, numbers: dict[bytes, int], base: int):
        super().__init__(numbers)
        self.base, self.most = base, len(numbers) + FLUSH

    def __missing__(self, word: bytes) -> int:
        unit = self.base + shape(word)
        if len(self) < self.most:
            self[word] = unit
        return unit


def count_words(df: DataFrame, text_col: str) -> DataFrame:
    """(word, shape, n) over all texts, the end of each text included as a word of shape -1."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ends = Counter(), 0

        def flush() -> pa.RecordBatch:
            words = list(held)
            return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in words], pa.string()), pa.array([-1 if w == END else shape(w) for w in words], pa.int32()), pa.array([held[w] for w in words], pa.int64())], names=["word", "shape", "n"])

        for batch in slices(batches, text_col):
            for text in texts(batch, text_col):
                held.update(tokens(text))
                ends += 1
            if len(held) > FLUSH:
                yield flush()
                held.clear()
        if ends:
            held[END] = ends
            yield flush()

    return df.select(text_col).mapInArrow(count, "word string, shape int, n bigint").groupBy("word", "shape").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """The ``most`` most frequent words (or all), by falling count, those of one count by code point.

    A histogram with a bounded number of bins (counts up to 1023 one by one, then 64 a doubling) gives the bin that holds the
    last of them; only inside it are words ranked.
    """
    step = F.when(F.col("n") < 1024, F.col("n")).otherwise(F.floor(F.log2(F.col("n").cast("double")) * 64) + 384)
    words = counts.filter("shape >= 0").select("word", "n", step.alias("b"))
    total, last = 0, None
    for r in sorted(words.groupBy("b").agg(F.count("*").alias("c")).collect(), key=lambda r: -r["b"]):
        last = r["b"]
        if total + r["c"] >= most:
            break
        total += r["c"]
    if last is None:
        return []
    above = words.filter(F.col("b") > last).select("word", "n").collect()
    edge = words.filter(F.col("b") == last).orderBy(F.desc("n"), "word").limit(most - total).select("word", "n").collect()
    return sorted(((r["word"].encode(), r["n"]) for r in [*above, *edge]), key=lambda x: (-x[1], x[0]))


def bigram_table(df: DataFrame, text_col: str, clustered: dict[bytes, int]) -> np.ndarray:
    """Counts of unit pairs as a square matrix: clustered words, shapes, end (which also stands before each text)."""
    size = len(clustered) + SHAPES + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, total = Units(clustered, len(clustered)), None
        for batch in slices(batches, text_col):
            line = [size - 1]
            for text in texts(batch, text_col):
                line.extend(map(unit.__getitem__, tokens(text)))
                line.append(size - 1)
            line = np.array(line, dtype=np.int64)
            found = np.bincount(line[:-1] * size + line[1:], minlength=size * size).astype(np.int32)
            total = found if total is None else total + found
        if total is not None:
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at].astype(np.int64))], names=["pair", "n"])

    table = df.select(text_col).mapInArrow(count, "pair int, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size * size)
    out[table["pair"].to_numpy()] = table["n"].to_numpy()
    return out.reshape(size, size)


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(pairs: np.ndarray, movable: int, classes: int = CLASSES) -> np.ndarray:
    """Class of each unit: the first ``movable`` units are exchanged among ``classes``, each other keeps its own.

    Units come by falling frequency; they start in turn.  A move is made only if it raises the likelihood, so
    the passes end, with one that moves none; ties keep a unit where it is.
    """
    n = len(pairs)
    classes = max(1, min(classes, movable))
    of = np.concatenate([np.arange(movable) % classes, classes + np.arange(n - movable)])
    k = classes + n - movable
    member = np.zeros((n, k))
    member[np.arange(n), of] = 1
    after, before = pairs @ member, pairs.T @ member  # of each unit: counts with each class behind and before it
    table = member.T @ after
    left, right = table.sum(axis=1), table.sum(axis=0)
    own, out_of, into = np.diag(pairs), pairs.sum(axis=1), pairs.sum(axis=0)
    where = np.arange(classes)
    least = 1e-11 * float(xlogx(pairs.sum())) + 1e-9  # above the error of sums of this size
    moved = 1
    while moved:
        moved = 0
        for u in range(movable):
            g = of[u]
            a, b = after[u].copy(), before[u].copy()
            a[g] -= own[u]
            b[g] -= own[u]
            table[g] -= a
            table[:, g] -= b
            table[g, g] -= own[u]
            left[g] -= out_of[u]
            right[g] -= into[u]
            rows, columns, corner = table[:classes], table[:, :classes].T, table[where, where]
            gain = (xlogx(rows + a) - xlogx(rows)).sum(axis=1) + (xlogx(columns + b) - xlogx(columns)).sum(axis=1)
            gain -= xlogx(corner + a[:classes]) + xlogx(corner + b[:classes]) - 2 * xlogx(corner)
            gain += xlogx(corner + a[:classes] + b[:classes] + own[u]) - xlogx(corner)
            gain -= xlogx(left[:classes] + out_of[u]) - xlogx(left[:classes]) + xlogx(right[:classes] + into[u]) - xlogx(right[:classes])
            best = int(gain.argmax())
            if gain[best] <= gain[g] + least:
                best = g
            else:
                moved += 1
                of[u] = best
                after[:, g] -= pairs[:, u]
                after[:, best] += pairs[:, u]
                before[:, g] -= pairs[u]
                before[:, best] += pairs[u]
            a, b = after[u].copy(), before[u].copy()
            a[best] -= own[u]
            b[best] -= own[u]
            table[best] += a
            table[:, best] += b
            table[best, best] += own[u]
            left[best] += out_of[u]
            right[best] += into[u]
    return of


def placed(df: DataFrame, text_col: str, words: list[bytes], of: np.ndarray, core: int, table: np.ndarray, classes: int) -> np.ndarray:
    """Class of each of ``words``: those of the first ``core``, as given; of each other the one that its contexts suit best.

    ``of``: class of the core words, the shapes and the end.  ``table``: the class bigrams so far, in which a word
    that isn't of the core counts by its shape.  Of a word, what is counted is how often each class stands right
    before and behind it; a class's gain is the rise of the class-bigram log-likelihood if these counts join its own.
    """
    listed, k = len(words), len(table)
    sent = df.sparkSession.sparkContext.broadcast((words, of))

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, classes_of = sent.value
        unit = Units({w: i for i, w in enumerate(known)}, listed)
        # The class that a unit has as a neighbour: words beyond the core count by shape.
        as_class = np.concatenate([classes_of[:core], [classes_of[core + shape(w)] for w in known[core:]], classes_of[core:]]).astype(np.int64)
        for batch in slices(batches, text_col):
            line = [listed + SHAPES]
            for text in texts(batch, text_col):
                line.extend(map(unit.__getitem__, tokens(text)))
                line.append(listed + SHAPES)
            line = np.array(line, dtype=np.int64)
            at = np.flatnonzero((line >= core) & (line < listed))
            near = np.concatenate([line[at] * 2 * k + as_class[line[at + 1]], (line[at] * 2 + 1) * k + as_class[line[at - 1]]])
            code, n = np.unique(near, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array((code // (2 * k)).astype(np.int32)), pa.array((code % (2 * k)).astype(np.int32)), pa.array(n.astype(np.int64))], names=["word", "near", "n"])
        trim()

    logs = xlogx(table)
    left, right = table.sum(axis=1)[:classes], table.sum(axis=0)[:classes]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for word, near, n in whole_words(batches):
            n = n.astype(float)
            gain = np.empty((word.size, classes))
            ahead = near < k
            c = np.where(ahead, near, near - k)
            for g in range(classes):
                now = np.where(ahead, table[g, c], table[c, g])
                gain[:, g] = xlogx(now + n) - np.where(ahead, logs[g, c], logs[c, g])
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            gain = np.add.reduceat(gain, first)
            out_of, into = (np.add.reduceat(np.where(side, n, 0.0), first)[:, None] for side in (ahead, ~ahead))
            gain -= xlogx(left + out_of) - xlogx(left) + xlogx(right + into) - xlogx(right)
            yield pa.RecordBatch.from_arrays([pa.array(word[first]), pa.array(gain.argmax(axis=1).astype(np.int32))], names=["word", "class"])

    counted = df.select(text_col).mapInArrow(contexts, "word int, near int, n bigint").groupBy("word", "near").agg(F.sum("n").alias("n"))
    found = counted.repartition("word").sortWithinPartitions("word", "near").mapInArrow(place, "word int, class int").toArrow()
    out = np.zeros(listed, dtype=np.int64)
    out[:core] = of[:core]
    out[found["word"].to_numpy()] = found["class"].to_numpy()
    sent.destroy()
    return out


def whole_words(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """The rows of about BLOCK words at a time, all rows of a word together; they come sorted by word."""
    held: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        own = tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        if not own[0].size:
            continue
        held.append(own)
        if np.unique(np.concatenate([h[0] for h in held])).size > BLOCK:
            word, near, n = (np.concatenate(x) for x in zip(*held))
            cut = int(np.searchsorted(word, word[-1]))
            yield word[:cut], near[:cut], n[:cut]
            held = [(word[cut:], near[cut:], n[cut:])]
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held))


def class_bigrams(df: DataFrame, text_col: str, words: list[bytes], cls: np.ndarray, k: int) -> np.ndarray:
    """How often each class stands right behind each other, over all tokens. ``cls``: of the words, the shapes, the end."""
    sent = df.sparkSession.sparkContext.broadcast((words, cls))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, classes_of = sent.value
        unit, total = Units({w: i for i, w in enumerate(known)}, len(known)), np.zeros(k * k, dtype=np.int64)
        for batch in slices(batches, text_col):
            line = [len(classes_of) - 1]
            for text in texts(batch, text_col):
                line.extend(map(unit.__getitem__, tokens(text)))
                line.append(len(classes_of) - 1)
            line = classes_of[np.array(line, dtype=np.int64)]
            total += np.bincount(line[:-1] * k + line[1:], minlength=k * k)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["pair", "n"])
        trim()

    table = df.select(text_col).mapInArrow(count, "pair int, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(k * k)
    out[table["pair"].to_numpy()] = table["n"].to_numpy()
    sent.destroy()
    return out.reshape(k, k)


@dataclass
class BrownModel:
    """A fitted model. ``counts`` is a stored table of all training words; the rest has a fixed bound."""

    counts: DataFrame
    train_tokens: int
    train_words: int
    known: list[tuple[bytes, int]]  # the broadcast words and their counts
    least: int  # all words of a higher count are among them
    cls: np.ndarray  # class of each known word, then of each shape, then of the end
    transition: np.ndarray  # log10 P(class | class before)
    spread: np.ndarray  # log10 of what a class shares among its words: its tokens and priors


def fit(df: DataFrame, text_col: str = "text", clustered: int = CLUSTERED, classes: int = CLASSES, broadcast: int = BROADCAST) -> BrownModel:
    """Fit on all rows of ``df``; null counts as the empty text. With no rows every class is as likely as any other."""
    counts = stored(count_words(df, text_col), "lm_counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count("*").alias("words")).first()
    known = frequent_words(counts, broadcast)
    ids = {w: i for i, (w, _) in enumerate(known[:clustered])}
    pairs = bigram_table(df, text_col, ids)
    of = exchange(pairs, len(ids), classes)
    k, core, words = int(of.max()) + 1, len(ids), [w for w, _ in known]
    member = np.zeros((len(of), k))
    member[np.arange(len(of)), of] = 1
    if len(words) > core:
        own = placed(df, text_col, words, of, core, member.T @ pairs @ member, max(1, min(classes, core)))
    else:
        own = of[:core]
    cls = np.concatenate([own, of[core:]])
    table = class_bigrams(df, text_col, words, cls, k)
    transition = np.log10((table + CLASS_PRIOR) / (table.sum(axis=1, keepdims=True) + CLASS_PRIOR * k))
    types = np.bincount(own, minlength=k).astype(float)
    for r in counts.filter("shape >= 0").groupBy("shape").agg(F.count("*").alias("c")).collect():
        types[of[core + r["shape"]]] += r["c"]
    for w in words:
        types[of[core + shape(w)]] -= 1
    spread = np.log10(table.sum(axis=0) + WORD_PRIOR * (types + 1))
    return BrownModel(counts, total["tokens"], total["words"], known, known[-1][1] if known else 1 << 62, cls, transition, spread)


def score(df: DataFrame, model: BrownModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row out for each row in: ``id_col``, ``n_tokens`` (words and the end), ``n_known`` (those seen in
    training), ``train_tokens``, ``base_score`` (log10 under the add-one unigram model), ``score`` (log10 under this
    one) and ``perplexity``.

    Null and empty texts are the end alone.  Repeated rows come out repeated.
    """
    n_known, floor = len(model.known), np.log10(model.train_tokens + model.train_words + 1)
    count = np.array([n for _, n in model.known], dtype=float)
    zeros = np.zeros(SHAPES)
    ends = float(model.counts.filter("shape = -1").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    base = np.concatenate([np.log10(count + 1) - floor, zeros, [np.log10(ends + 1) - floor]])
    emit = np.concatenate([np.log10(count + WORD_PRIOR), zeros, [0.0]]) - np.append(model.spread[model.cls[:-1]], 0.0)
    sent = df.sparkSession.sparkContext.broadcast(([w for w, _ in model.known], base, emit, model.cls, model.transition, ends > 0))
    kind = df.schema[id_col].dataType.simpleString()

    class Partial:
        def start(self) -> None:
            words, self.base, self.emit, self.cls, self.transition, self.end_known = sent.value
            self.number, self.n = Units({w: i for i, w in enumerate(words)}, len(words)), len(words)

        def __call__(self, batch: pa.RecordBatch) -> dict:
            out = {c: [] for c in ("n_tokens", "n_known", "base", "score", "words", "times")}
            end = self.n + SHAPES
            for text in texts(batch, text_col):
                found = tokens(text)
                unit = np.fromiter(map(self.number.__getitem__, found), dtype=np.int64, count=len(found))
                rare = np.flatnonzero(unit >= self.n)
                unit = np.append(unit, end)
                cls = self.cls[unit]
                times = Counter(found[i] for i in rare.tolist())
                out["n_tokens"].append(unit.size)
                out["n_known"].append(unit.size - 1 - rare.size + self.end_known)
                out["base"].append(float(self.base[unit].sum()))
                out["score"].append(float(self.emit[unit].sum() + self.transition[np.append(self.cls[-1], cls[:-1]), cls].sum()))
                out["words"].append([w.decode() for w in times])
                out["times"].append(list(times.values()))
            return {id_col: values(batch, id_col), **out}

    partial = arrow_map(df.select(id_col, text_col), Partial(), f"`{id_col}` {kind}, n_tokens bigint, n_known bigint, base double, score double, words array<string>, times array<int>", text_col)
    partial = stored(partial.withColumn("row", F.monotonically_increasing_id()), "lm_partial")
    rare = partial.select("row", F.explode(F.arrays_zip("words", "times")).alias("r")).select("row", F.col("r.words").alias("word"), F.col("r.times").alias("times"))
    counts = model.counts.filter((F.col("shape") >= 0) & (F.col("n") <= model.least)).select("word", "n")
    met = rare.join(counts, "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    sums = met.groupBy("row").agg(
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("more_known"),
        F.sum(F.col("times") * (F.log10(F.col("n") + 1) - F.lit(float(floor)))).alias("more_base"),
        F.sum(F.col("times") * F.log10(F.col("n") + WORD_PRIOR)).alias("more_score"),
    )
    whole = partial.drop("words", "times").join(sums, "row", "left")
    total = F.col("score") + F.coalesce("more_score", F.lit(0.0))
    return whole.select(
        id_col,
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(int(model.train_tokens)).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        total.alias("score"),
        F.pow(F.lit(10.0), -total / F.col("n_tokens")).alias("perplexity"),
    )
