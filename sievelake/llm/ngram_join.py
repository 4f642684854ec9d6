"""N-gram Jaccard self-join with token-combination prefixes.

A document's set holds its distinct word shingles as 64-bit hashes (of hashes of their words).  All sets are read in one
global order, rare shingles first, and only a prefix of each is indexed.  Shingles are of two classes: rare ones are
indexed one by one; frequent ones only in combinations of two, and only with shingles of the same sub-class.  Of n
shingles of a set at most ``slack = n - ceil(threshold * n)`` are missing from a set that is similar to it.  A rare shingle
that is shared gives a common signature, and so do two frequent ones of a sub-class, so with no common signature the
prefix must miss ``sum(rare: 1 each; sub-class of m frequent ones: m - 1)`` shingles.  The prefix is extended until this
sum is ``slack + 1``: similar sets then share a signature.  (The prefix that ends first in the global order lies in
the other set's as far as it is shared, so the argument needs only that one.)

The number of sub-classes follows the size: sets are of one level if their sizes are within a factor of the threshold, and
a set is indexed for its own level and the next, so that similar sets meet in one.

What is frequent, a table of counters says: counts of all shingles of all documents, folded into a table of fixed
size that every worker gets.  Folding may call a rare shingle frequent; the join stays exact, because every
document sees the same table.  A counter also bounds how many sets have a signature, so buckets that may be large are
known beforehand: these go by aggregates and joins that split, all others by windows over at most HOT_BUCKET sets.

Copies (equal words in equal order) are one node, by a 128-bit digest of their words.  Candidates are verified on whole
sets, in two steps that spare groups of near copies their square: first each set of a signature's bucket against one
other, the next smaller (or, in a large bucket, the first); then, of buckets whose sets the verified links so far leave
in several components, the sets outside the bucket's largest component against all others not of their own.  Pairs
inside one component aren't looked at: they can't change it.  A pair is verified only if sizes and parity bitmaps allow the
link: a bitmap holds, for each of BITS folds of the hashes, whether the set has an odd number of them, so two
bitmaps differ in at most as many places as the sets in members.  What verifies a pair are the shingles' words.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shared import Scratch, arrow_map, slices, spread_join, stored, texts, trim, values

#: What near copies are unless a caller says otherwise: words of a shingle, and the least likeness in hundredths.
WORDS, THRESHOLD = 5, 80
#: Counters of the table, and how many times a counter's mean load makes a shingle frequent.
COUNTERS, FREQUENT = 1 << 22, 3
#: A signature whose counters allow more sets than this is handled without gathering its bucket.
HOT_BUCKET = 512
#: Places of a parity bitmap, kept as 64-bit integers, and how many of these integers go along with a signature.
BITS, FOLDED = 1024, 4
#: Counters are summed in so many pieces.
PIECES = 64
#: Below so many shingles all are indexed one by one: there are too few to combine.
SMALL_SET = 20
#: Bytes of text that a worker takes at a time.
SLICE = 2 << 20


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def tokens(text: str) -> list[bytes]:
    """Words of a text, A-Z lowered, parted at ASCII white space."""
    return text.encode().lower().split()


def shingles(found: list[bytes], words: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a sequence of words.

    With fewer words than ``words`` the whole sequence is the one shingle; without words there is none.
    """
    if not found:
        return np.zeros(0, dtype=np.uint64)
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, found), dtype=np.uint64, count=len(found))
    width = min(words, each.size)
    n = each.size - width + 1
    h = each[:n] + np.uint64(width)
    for k in range(1, width):
        h = mixed(h) + each[k : k + n]
    return np.unique(mixed(h))


def worded(found: list[bytes], words: int) -> set[bytes]:
    """The shingles themselves: their words, parted by blanks."""
    width = min(words, len(found))
    return {b" ".join(found[i : i + width]) for i in range(len(found) - width + 1)} if found else set()


def linked(a: list[bytes], b: list[bytes], words: int, threshold: int) -> bool:
    x, y = worded(a, words), worded(b, words)
    both = len(x & y)
    return bool(x and y) and 100 * both >= threshold * (len(x) + len(y) - both)


def text_key(found: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(found))


def parity(found: np.ndarray) -> np.ndarray:
    """Place k of the bitmap: whether an odd number of hashes are k modulo BITS."""
    odd = np.bincount((found & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def slack(n: int, threshold: int) -> int:
    return n - -(-threshold * n // 100)


def level_of(n: int, threshold: int) -> int:
    return int(np.floor(np.log(n) / np.log(100 / threshold) + 1e-9))


def signatures(found: np.ndarray, counters: np.ndarray, frequent: int, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """The signatures of a set, of its prefixes for its own level and the next, and how many sets may have each at most."""
    if not found.size:
        return found, found
    count = counters[found & np.uint64(counters.size - 1)]
    order = np.lexsort((found, count))
    ranked, count = found[order], count[order]
    need = slack(found.size, threshold) + 1
    rare = int(np.searchsorted(count > frequent, True))  # counts ascend: the rare ones come first
    if rare >= need:
        return ranked[:need], count[:need]
    out, bound = [ranked[:rare]], [count[:rare]]
    rest, count = ranked[rare:], count[rare:]
    own = level_of(found.size, threshold)
    for level in (own, own + 1):
        least = (100 / threshold) ** level
        if least < SMALL_SET:
            out.append(rest[: need - rare])
            bound.append(count[: need - rare])
            continue
        groups = max(1, int(least / 10))
        group = ((rest >> np.uint64(20)) % np.uint64(groups)).astype(np.int64)
        by = np.argsort(group, kind="stable")
        again = np.zeros(rest.size, dtype=np.int64)
        again[by[1:]] = group[by[1:]] == group[by[:-1]]  # 0 for the first of its sub-class, else 1
        end = int(np.searchsorted(np.cumsum(again), need - rare)) + 1
        rest_in, group_in = rest[:end], group[:end]
        by = np.argsort(group_in, kind="stable")
        cuts = np.flatnonzero(np.diff(group_in[by])) + 1
        for members in np.split(by, cuts):
            if members.size > 1:
                i, j = np.triu_indices(members.size, 1)
                a, b = rest_in[members[i]], rest_in[members[j]]
                out.append(mixed(np.minimum(a, b) * np.uint64(3) + mixed(np.maximum(a, b) + np.uint64(level))))
                bound.append(np.minimum(count[members[i]], count[members[j]]))
    found, at = np.unique(np.concatenate(out), return_index=True)
    return found, np.concatenate(bound)[at]


def count_shingles(df: DataFrame, text_col: str, words: int) -> np.ndarray:
    """Counters of the shingles of all texts, summed over the tasks in two steps, in pieces."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters, some = np.zeros(COUNTERS, dtype=np.uint32), False
        for batch in slices(batches, text_col, SLICE):
            some = True
            found = [shingles(tokens(t), words) for t in texts(batch, text_col)]
            at, times = np.unique(np.concatenate(found) & np.uint64(COUNTERS - 1), return_counts=True)
            counters[at] += times.astype(np.uint32)
        if some:
            for piece, part in enumerate(np.split(counters.astype("<u4"), PIECES)):
                yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([zstandard.compress(part.tobytes(), 1)], pa.binary())], names=["piece", "counts"])
        del counters
        trim()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, data in zip(values(batch, "piece"), batch.column(batch.schema.get_field_index("counts"))):
                total[piece] = total.get(piece, 0) + np.frombuffer(zstandard.decompress(data.as_py()), dtype="<u4").astype(np.int64)
        for piece, sums in total.items():
            part = np.minimum(sums, 2**32 - 1).astype("<u4")
            yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([zstandard.compress(part.tobytes(), 1)], pa.binary())], names=["piece", "counts"])

    pieces = df.select(text_col).mapInArrow(count, "piece int, counts binary")
    once = pieces.withColumn("salt", F.spark_partition_id() % 16).repartition(PIECES, "piece", "salt").mapInArrow(add, "piece int, counts binary")
    found = {r["piece"]: r["counts"] for r in once.repartition(PIECES, "piece").mapInArrow(add, "piece int, counts binary").collect()}
    if not found:
        return np.zeros(COUNTERS, dtype=np.uint32)
    return np.frombuffer(b"".join(zstandard.decompress(found[p]) for p in range(PIECES)), dtype="<u4")


#: The table of counters that this worker holds, by its name: one at a time.
HELD: dict[str, np.ndarray] = {}


def lists(found: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *(f.size for f in found)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *(f.view(np.int64) for f in found)])))


def ngram_join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """One row out for each row in: ``id_col``, ``n_shingles`` (size of its set), ``component_id`` (smallest id that
    links reach, its own included).  Two documents link if 100 * shared shingles >= threshold * all shingles of both.

    Copies link through the smallest id among them, so they cost one set.  Null and empty texts, or those of white space
    alone, have no shingle and link with nothing.  Ids are integers; a null id is a row of its own component (null)
    unless its words are another's, too.  Rows that share an id are taken for one row repeated.  Other columns are
    ignored, whatever their names; an empty table gives an empty result.
    """
    spark = df.sparkSession
    kind = df.schema[id_col].dataType.simpleString()
    source, scratch = df.select(id_col, text_col), Scratch(spark, "ngram")
    counters = count_shingles(source, text_col, words)
    frequent, hot_bucket = max(8, int(FREQUENT * counters.sum(dtype=np.int64) / COUNTERS)), HOT_BUCKET
    table, name = spark.sparkContext.broadcast(zstandard.compress(counters.tobytes(), 1)), uuid.uuid4().hex

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in HELD:
            HELD.clear()
            HELD[name] = np.frombuffer(zstandard.decompress(table.value), dtype="<u4")
        for batch in slices(batches, text_col, SLICE):
            sizes, keys, bits, cold, hot = [], [], [], [], []
            for text in texts(batch, text_col):
                found = tokens(text)
                own = shingles(found, words)
                sigs, bound = signatures(own, HELD[name], frequent, threshold)
                sizes.append(own.size)
                keys.append(text_key(found) if found else None)
                bits.append(parity(own))
                cold.append(sigs[bound <= hot_bucket])
                hot.append(sigs[bound > hot_bucket])
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(id_col)), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), lists(bits), lists(cold), lists(hot)], names=["id", "n", "key", "bits", "cold", "hot"])
        HELD.clear()
        trim()

    every = scratch(source.mapInArrow(index, f"id {kind}, n bigint, key binary, bits array<bigint>, cold array<bigint>, hot array<bigint>"), "sets")
    names = scratch(every.filter("key is not null").groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("rows")), "names")
    docs = spread_join(every.select("id", "n", "key").filter("key is not null"), names, "key", "rows", F.col("id")).select("id", "n", "rep")
    docs = scratch(docs, "docs")
    sets = every.filter("key is not null and id is not null").join(docs.filter("id != rep").select("id"), "id", "left_anti")
    again = not docs.filter("id = rep").groupBy("id").count().filter("count > 1").isEmpty()
    if again:
        sets = scratch(sets.dropDuplicates(["id"]), "sets")

    def fits(m: str, n: str) -> Column:
        return F.lit(100) * F.least(m, n) >= F.lit(threshold) * F.greatest(m, n)

    # A set stays in a bucket only if one next to it by size, and so any, may be like it.
    one = sets.select("id", F.col("n").cast("int").alias("n"), F.explode("cold").alias("sig"))
    by_size = Window.partitionBy("sig").orderBy("n", "id")
    one = one.withColumn("pivot", F.lag("id").over(by_size)).withColumn("below", F.lag("n").over(by_size)).withColumn("above", F.lead("n").over(by_size))
    up, down = (F.col(c).isNotNull() & fits("n", c) for c in ("above", "below"))  # least and greatest pass over nulls
    cold = scratch(one.filter(up | down).select("sig", "id", "n", F.when(down, F.col("pivot")).alias("pivot")), "cold")
    one = sets.select("id", F.col("n").cast("int").alias("n"), F.explode("hot").alias("sig"))
    firsts = one.groupBy("sig").agg(F.min(F.struct("id", "n")).alias("first"), F.max("id").alias("last"), F.count("*").alias("rows"))
    firsts = scratch(firsts.filter("first.id != last").select("sig", "first", "rows"), "firsts")
    hot = spread_join(one, firsts, "sig", "rows", F.col("id")).select("sig", "id", "n", F.when(fits("n", "first.n") & (F.col("id") != F.col("first.id")), F.col("first.id")).alias("pivot"))
    hot = scratch(hot, "hot")

    bitmaps = sets.select("id", F.col("n").alias("size"), *(F.get("bits", F.lit(i)).alias(f"x{i}") for i in range(BITS // 64)))

    def close(a: str, b: str, parts: int, sizes: Column) -> Column:
        """Whether the bitmaps ``a`` and ``b``, of ``parts`` integers, allow a link between sets of these sizes together."""
        apart = sum((F.bit_count(F.col(f"{a}{i}").bitwiseXOR(F.col(f"{b}{i}"))) for i in range(parts)), F.lit(0))
        return (100 + threshold) * apart <= (100 - threshold) * sizes

    class Pack:
        def __call__(self, batch: pa.RecordBatch) -> dict:
            small = zstandard.ZstdCompressor(level=3)
            return {"id": values(batch, id_col), "text": [small.compress(t.encode()) for t in texts(batch, text_col)]}

    packed = arrow_map(source, Pack(), f"id {kind}, text binary", text_col, SLICE)

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """Of pairs (a < b) those that link: by bitmaps, by hashes and at last by words."""
        left, right = (bitmaps.select(F.col("id").alias(k), F.col("size").alias(f"n{k}"), *(F.col(f"x{i}").alias(f"{k}{i}") for i in range(BITS // 64))) for k in "ab")
        likely = pairs.distinct().join(left, "a").join(right, "b").filter(close("a", "b", BITS // 64, F.col("na") + F.col("nb")))
        likely = scratch(likely.select("a", "b"), f"{name}_pairs")
        wanted = likely.select(F.col("a").alias("id")).union(likely.select(F.col("b").alias("id"))).distinct()
        bodies = packed.join(wanted, "id", "left_semi")
        bodies = scratch(bodies.dropDuplicates(["id"]) if again else bodies, f"{name}_bodies")

        def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            unpack = zstandard.ZstdDecompressor()
            known: dict[int, tuple[list[bytes], np.ndarray]] = {}

            def of(name: int, data) -> tuple[list[bytes], np.ndarray]:
                if name not in known:
                    if len(known) >= 64:
                        known.clear()
                    found = tokens(unpack.decompress(data.as_py()).decode())
                    known[name] = found, shingles(found, words)
                return known[name]

            for batch in slices(batches, "text_b", SLICE):
                left, right = [], []
                columns = [batch.column(batch.schema.get_field_index(c)) for c in ("text_a", "text_b")]
                for i, (a, b) in enumerate(zip(values(batch, "a"), values(batch, "b"))):
                    (u, x), (v, y) = of(a, columns[0][i]), of(b, columns[1][i])
                    both = np.intersect1d(x, y, assume_unique=True).size
                    if 100 * both >= threshold * (x.size + y.size - both) and linked(u, v, words, threshold):
                        left.append(a)
                        right.append(b)
                ids = batch.schema.field("a").type
                yield pa.RecordBatch.from_arrays([pa.array(left, ids), pa.array(right, ids)], names=["a", "b"])
            known.clear()
            trim()

        with_a = likely.join(bodies.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
        with_b = with_a.join(bodies.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
        return scratch(with_b.select("a", "b", "text_a", "text_b").mapInArrow(check, f"a {kind}, b {kind}"), name)

    def ordered(a: str, b: str) -> tuple[Column, Column]:
        return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")

    # First step: every set of a bucket against the next smaller, or the first, of its bucket.
    pairs = cold.filter("pivot is not null").select(*ordered("pivot", "id")).union(hot.filter("pivot is not null").select(*ordered("pivot", "id")))
    links = verified(pairs, "links")
    labels = components(links)

    # Second step: buckets whose sets are of several components still.
    folded = sets.select("id", *(sum_xor([F.get("bits", F.lit(i)) for i in range(k, BITS // 64, FOLDED)]).alias(f"x{k}") for k in range(FOLDED)))

    def labelled(rows: DataFrame) -> DataFrame:
        own = rows.select("sig", "id", "n").join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("label", "id"))
        return own.join(folded, "id")

    def cross(rows: DataFrame, salts: Column) -> DataFrame:
        """Pairs of each bucket's sets outside its main component with all that aren't of theirs. ``rows``: with ``main``."""
        few = rows.filter("label != main").select("sig", F.col("id").alias("u"), F.col("n").alias("nu"), F.col("label").alias("lu"), *(F.col(f"x{k}").alias(f"u{k}") for k in range(FOLDED)), F.pmod(F.xxhash64("id"), salts).cast("int").alias("salt"))
        rest = rows.select("sig", F.col("id").alias("v"), F.col("n").alias("nv"), F.col("label").alias("lv"), (F.col("label") == F.col("main")).alias("in_main"), *(F.col(f"x{k}").alias(f"v{k}") for k in range(FOLDED)), F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
        met = few.join(rest, ["sig", "salt"]).filter((F.col("lu") != F.col("lv")) & (F.col("in_main") | (F.col("u") < F.col("v"))) & fits("nu", "nv") & close("u", "v", FOLDED, F.col("nu") + F.col("nv")))
        return met.select(*ordered("u", "v"))

    bucket = Window.partitionBy("sig")
    some = labelled(cold).withColumn("low", F.min("label").over(bucket)).withColumn("high", F.max("label").over(bucket)).filter("low != high")
    some = some.withColumn("c", F.count("*").over(Window.partitionBy("sig", "label"))).withColumn("main", F.max(F.struct("c", "label")).over(bucket)["label"])
    some = scratch(some.drop("low", "high", "c"), "mixed")
    pairs = cross(some, F.lit(1))
    if not hot.isEmpty():
        many = scratch(labelled(hot), "mixed")
        of = many.groupBy("sig", "label").agg(F.count("*").alias("c")).groupBy("sig").agg(F.max(F.struct("c", "label")).alias("main"), F.sum("c").alias("rows"), F.count("*").alias("labels"))
        of = scratch(of.filter("labels > 1").select("sig", F.col("main.label").alias("main"), "rows", F.ceil((F.col("rows") - F.col("main.c")) / hot_bucket).cast("int").alias("salts")), "mains")
        pairs = pairs.union(cross(spread_join(many, of, "sig", "rows", F.col("id")), F.col("salts")))
    more = verified(pairs, "more")
    found = components(links.union(more)) if not more.isEmpty() else labels

    sizes = docs.groupBy("rep").agg(F.count("*").alias("rows"))
    named = scratch(sizes.join(found.withColumnRenamed("node", "rep"), "rep").select("rep", "rows", "label"), "named")
    out = spread_join(docs, named, "rep", "rows", F.col("id"), "left").select("id", "n", F.coalesce("label", "rep").alias("component"))
    out = out.union(every.filter("key is null").select("id", "n", F.col("id").alias("component")))
    out = stored(out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id")), "ngram_components")
    scratch.drop()
    table.destroy()
    return out


def sum_xor(columns: list[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out.bitwiseXOR(c)
    return out
