"""Line deduplication over content-defined chunks of lines; DataFrame functions only.

Each line has a hash; a rolling hash over it and the line before it decides, from those two lines alone, whether
a chunk ends there.  So a passage that stands in several documents is cut alike in all of them, whatever
lines are before it, but for its first lines.  Chunks of at least ``min_lines`` lines that occur more than once, in
all documents together, stay where they occur first and are removed everywhere else.

Equal chunks are found by digest and whole text together; the digest alone only carries the decision back
to the documents, after a check that it belongs to one text.

Such chunks miss passages of one line and the ends of longer ones: a chunk with a repeated line mostly has a differing
neighbour, too.  ``drop_passages`` takes those.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import NOT_BLANKS, Scratch, let, spread_join, stored, unused, whole

#: Ends fall where ``(hash + FACTOR * hash of the line before) % EVERY`` is 0: a chunk has EVERY lines on average.
FACTOR, EVERY, MIN_LINES = 31, 3, 2
#: Words that a repeated passage has at least.
LEAST_WORDS = 8


def chunks(text: Column, every: int = EVERY) -> Column:
    """The chunks of a text: array of (pos, start, end), as line numbers from 0 with the end left out."""
    hashes = F.transform(F.split(text, "\n", -1), lambda line: F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("bigint"))

    def ends(h: Column) -> Column:
        before = F.concat(F.array(F.lit(0).cast("bigint")), h)
        falls = F.zip_with(h, before, lambda now, last: (now + FACTOR * last) % every == 0)  # one longer, with a null
        return let(F.size(h), lambda n: F.filter(F.transform(falls, lambda f, i: F.when((i < n) & (f | (i == n - 1)), i + 1)), lambda end: end.isNotNull()))

    def cut(e: Column) -> Column:
        return F.transform(e, lambda end, k: F.struct(k.alias("pos"), F.coalesce(F.get(e, k - 1), F.lit(0)).alias("start"), end.alias("end")))

    return let(let(hashes, ends), cut)


def row_key(id_col: str, text_col: str) -> Column:
    """128 bits for a row's id and text: rows that share it are one row repeated. Without an id, for the text alone."""
    return F.unhex(F.md5(F.concat_ws("|", F.col(id_col).cast("string"), F.lit(""), F.col(text_col))))


def line_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = EVERY, min_lines: int = MIN_LINES, report: bool = True) -> DataFrame:
    """The rows of ``df`` with repeated chunks taken out of ``text_col``, and three columns more if ``report``:
    ``n_lines`` (before), ``lines_removed`` and ``chunks_removed``, in place of any columns that have these names.

    The first occurrence is the one in the row with the smallest id (an integer; null last), then the
    earliest in its text.  Chunks of white space alone are left.  A null text stays null, with 0 lines; a text of
    which all is removed becomes empty; its row stays.  Rows that share id and text are one row repeated and are
    treated alike, so a chunk isn't removed because its own row is repeated.  All other columns of ``df`` stay as they are;
    those made on the way get names that it doesn't have.
    """
    key, gone_col, n_col = (unused(df, c) for c in ("__key", "__gone", "__n"))
    lines = F.split(F.col(text_col), "\n", -1)
    held = df.withColumn(key, row_key(id_col, text_col))

    def bodies(own: Column) -> Column:
        return F.transform(chunks(F.col(text_col), every), lambda c: F.struct(c["pos"].alias("pos"), (c["end"] - c["start"]).alias("n"), F.array_join(F.slice(own, c["start"] + 1, c["end"] - c["start"]), "\n").alias("body")))

    # Joined inside the array: exploding line numbers would copy all lines of a document beside each chunk.
    cut = held.select(F.col(key).alias("__key"), F.col(id_col).alias("__id"), F.explode(let(lines, bodies)).alias("__c")).select("__key", "__id", "__c.*")
    # The smaller number is the earlier occurrence; a number, so that the aggregate hashes instead of sorting texts.
    order = (F.coalesce(F.col("__id").cast("decimal(20,0)"), whole(2**63)) * whole(2**31) + F.col("pos").cast("decimal(10,0)")).cast("decimal(38,0)")
    cut = cut.filter((F.col("n") >= min_lines) & F.col("body").rlike(NOT_BLANKS)).select("__key", "pos", "n", "body", F.unhex(F.md5("body")).alias("digest"), order.alias("order"))
    # Occurrences of one row repeated have one order and key: they count once, by the largest and the smallest order.
    groups = cut.groupBy("digest", "body").agg(F.min("order").alias("first"), F.max("order").alias("last"), F.count("*").alias("rows"))
    groups = groups.groupBy("digest").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.count("*").alias("texts"), F.sum("rows").alias("rows"))
    table = stored(groups.filter("first < last"), "line_dedup")
    places = cut.select("__key", "pos", "n", "digest", "order")
    gone = spread_join(places, table.filter("texts = 1").select("digest", "first", "rows"), "digest", "rows", F.col("__key")).filter("order > first").select("__key", "pos", "n")
    if not table.filter("texts > 1").isEmpty():  # different chunks of one digest: told apart by their texts
        clash = table.filter("texts > 1").select("digest")
        of = cut.join(clash, "digest", "left_semi")
        apart = of.groupBy("digest", "body").agg(F.min("order").alias("first"))
        gone = gone.unionByName(of.join(apart, ["digest", "body"]).filter("order > first").select("__key", "pos", "n"))
    gone = gone.distinct().groupBy("__key").agg(F.collect_list("pos").alias(gone_col), F.sum("n").alias(n_col)).withColumnRenamed("__key", key)
    left = F.filter(chunks(F.col(text_col), every), lambda c: ~F.array_contains(gone_col, c["pos"]))
    text = let(lines, lambda own: F.array_join(F.flatten(F.transform(left, lambda c: F.slice(own, c["start"] + 1, c["end"] - c["start"]))), "\n"))
    out = held.join(gone, key, "left")
    if report:
        counts = {
            "n_lines": F.when(F.col(text_col).isNull(), 0).otherwise(F.size(lines)).cast("bigint"),
            "lines_removed": F.coalesce(F.col(n_col), F.lit(0)).cast("bigint"),
            "chunks_removed": F.when(F.col(gone_col).isNull(), 0).otherwise(F.size(gone_col)).cast("bigint"),
        }
        out = out.withColumns(counts)
    return out.withColumn(text_col, F.when(F.col(gone_col).isNull(), F.col(text_col)).otherwise(text)).drop(key, gone_col, n_col)


def windows(text: Column, least_words: int = LEAST_WORDS) -> Column:
    """For each line of a text that isn't blank, the shortest run of such lines from it on, and the shortest that ends
    with it, of at least ``least_words`` words: array of (start, at, digest), as number of the first line among those
    that aren't blank, numbers of the lines in the text, and SHA-256 over the lines' SHA-256.

    Every line of a passage of that many words lies in a run that lies in the passage, so equal runs find whole passages.
    """

    def run(part: Column) -> Column:
        """How many lines from the first on have enough words; null if all have too few."""
        step = lambda acc, x: F.when(acc["words"] >= least_words, acc).otherwise(F.struct((acc["words"] + x["words"]).alias("words"), (acc["n"] + 1).alias("n")))
        return F.aggregate(part, F.struct(F.lit(0).alias("words"), F.lit(0).alias("n")), step, lambda acc: F.when(acc["words"] >= least_words, acc["n"]))

    def runs(own: Column) -> Column:
        def of(start: Column, n: Column) -> Column:
            part = F.slice(own, start + 1, n)
            return F.struct(start.alias("start"), F.transform(part, lambda x: x["at"]).alias("at"), F.unhex(F.sha2(F.array_join(F.transform(part, lambda x: x["digest"]), ""), 256)).alias("digest"))

        onward = F.transform(own, lambda x, i: let(run(F.slice(own, i + 1, least_words)), lambda n: F.when(n.isNotNull(), of(i, n))))
        upto = F.transform(own, lambda x, i: let(run(F.reverse(F.slice(own, F.greatest(i + 2 - least_words, F.lit(1)), F.least(i + 1, F.lit(least_words))))), lambda n: F.when(n.isNotNull(), of(i + 1 - n, n))))
        return F.filter(F.array_distinct(F.concat(onward, upto)), lambda x: x.isNotNull())

    counted = F.transform(F.split(text, "\n", -1), lambda line, i: F.struct(i.alias("at"), F.regexp_count(line, F.lit(NOT_BLANKS)).alias("words"), F.sha2(line, 256).alias("digest")))
    return let(F.filter(counted, lambda x: x["words"] > 0), runs)


def drop_passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS, among: DataFrame | None = None) -> DataFrame:
    """The rows of ``df`` without the passages of whole lines, one or more, that have at least ``least_words`` words
    and stand earlier: in a row with a smaller id (an integer; null last), or before in the same text and apart.

    Lines that aren't blank make a passage even if blank lines are between them; blank lines stay.  Each line that is
    taken out stands where it occurs first.  Null texts stay null, and a text may become empty.

    ``among``: one column of ids, each of one row of ``df`` and not null; then only these rows count and come back, as if ``df`` had
    no others, but its texts go through one shuffle, not several.
    """
    key, gone_col = unused(df, "__key"), unused(df, "__gone")
    held = df.withColumn(key, row_key(id_col, text_col) if among is None else F.col(id_col))
    # Texts become digests where they are read, before the join, so that it shuffles no text.
    cut = held.select(F.col(key).alias("__key"), F.col(id_col).alias("__id"), windows(F.col(text_col), least_words).alias("__w"))
    if among is not None:
        among = among.toDF("__key")
        cut = cut.join(among, "__key")
    scratch = Scratch(df.sparkSession, "passages")
    # The outer form, because Spark would move the filter for empty arrays that it gives the other to the texts, and make all runs again for it.
    cut = cut.select("__key", "__id", F.explode_outer("__w").alias("__w")).select("__key", "__id", "__w.*")
    cut = scratch(cut.filter("digest IS NOT NULL"), "runs")
    order = (F.coalesce(F.col("__id").cast("decimal(20,0)"), whole(2**63)) * whole(2**31) + F.col("start").cast("decimal(10,0)")).cast("decimal(38,0)")
    cut = cut.select("__key", "at", "digest", order.alias("order"))
    groups = cut.groupBy("digest").agg(F.min("order").alias("first"), F.max("order").alias("last"), F.count("*").alias("rows"))
    table = scratch(groups.filter("first < last").select("digest", "first", "rows"), "repeated")
    # A run that overlaps its first occurrence in the same text would take a part of that.
    gone = spread_join(cut, table, "digest", "rows", F.col("__key")).filter(F.col("order") - F.col("first") >= F.size("at")).select("__key", F.explode("at").alias("at"))
    gone = stored(gone.groupBy("__key").agg(F.collect_set("at").alias(gone_col)), "passages")
    scratch.drop()
    if among is not None:
        gone = among.join(gone, "__key", "left")
    lines = F.split(F.col(text_col), "\n", -1)
    left = let(lines, lambda own: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(own) - 1), F.col(gone_col)), lambda i: F.get(own, i)), "\n"))
    out = held.join(gone.withColumnRenamed("__key", key), key, "left" if among is None else "inner")
    return out.withColumn(text_col, F.when(F.col(gone_col).isNull(), F.col(text_col)).otherwise(left)).drop(key, gone_col)


ORACLE_SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents),
hashed AS (SELECT doc_id, line, i, ('0x' || substr(md5(line), 1, 8))::BIGINT AS h FROM lines),
ended AS (
  SELECT *, (h + coalesce({FACTOR} * lag(h) OVER w, 0)) % {EVERY} = 0 AS ends FROM hashed WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
numbered AS (
  SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM ended),
cut AS (SELECT doc_id, pos, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS body FROM numbered GROUP BY ALL),
marked AS (
  SELECT *, n >= {MIN_LINES} AND regexp_matches(body, '[^\\x09-\\x0D\\x20]')
            AND row_number() OVER (PARTITION BY body, n >= {MIN_LINES} ORDER BY doc_id, pos) > 1 AS gone FROM cut)
SELECT doc_id, sum(n)::BIGINT AS n_lines, coalesce(sum(n) FILTER (WHERE gone), 0)::BIGINT AS lines_removed,
       count(*) FILTER (WHERE gone) AS chunks_removed, coalesce(string_agg(body, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text
FROM marked GROUP BY doc_id
"""
