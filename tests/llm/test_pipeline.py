"""The pipeline's stages, each held against the operator's brute-force version on what its predecessor kept."""

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from .test_operators import SF, brute_components, brute_lines, rows

from sievelake.llm import byte_bpe, mixing
from sievelake.llm.shared import stored


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    steps = dict(corpus_pipeline.STAGES)
    kept = steps["language_id"](spark, docs, SF)
    assert kept.columns == names and {r["doc_id"] for r in rows(kept)} == {r["doc_id"] for r in rows(docs)}

    clean = steps["line_dedup"](spark, kept, SF)
    want = brute_lines([(r["doc_id"], r["text"]) for r in rows(kept)])
    assert clean.columns == names and {r["doc_id"]: r["text"] for r in rows(clean)} == {i: w[2] for i, w in want.items()}
    assert clean.filter(F.col("n_chars") != F.char_length("text")).count() == 0

    single = steps["ngram_join"](spark, clean, SF)
    parts = brute_components([(r["doc_id"], r["text"]) for r in rows(clean)])
    assert single.columns == names and {r["doc_id"] for r in rows(single)} == {i for i, (_, c) in parts.items() if i == c}

    mixed = steps["mixing"](spark, single, SF)
    copies = {r["doc_id"]: r["copies"] for r in rows(mixing.mix(single)) if r["copies"]}
    got = {}
    for r in rows(mixed):
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
    assert mixed.columns == names and got == copies

    out = steps["byte_bpe"](spark, mixed, SF)
    assert out.count() == sum(copies.values()) and "ids" in out.columns


def test_texts_of_no_language_go(spark):
    """Letters without a language, of all lengths, beside the shortest clean texts and rows that the table may have."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    draw = np.random.default_rng(0)

    def made(letters, n):
        return " ".join("".join(draw.choice(list(letters), draw.integers(3, 9))) for _ in range(n))

    junk = [made(x, n) for x in ("bcdfghjklmnpqrstvwxz", "абвгдежзиклмнопрст", "ᚠᚢᚦᚨᚱᚲᚷᚹᚺᚾ", "日本語東京都大学研究所") for n in (20, 80, 400)] + [None, "", " \n", "12 34", "!!!"]
    clean = sorted((r["text"] for r in rows(docs) if r["text"] and len(r["text"]) > 8), key=len)[:40] + ["La armi racoos doar y.", "Taie, rr ñja chóná con no. chllaando", "Onsh anor password=16ad8794c8a97c335d it re."]
    table = spark.createDataFrame([(900_000 + i, t, None, "z", 0) for i, t in enumerate(junk + clean)], docs.schema)
    kept = {r["doc_id"] - 900_000 for r in rows(dict(corpus_pipeline.STAGES)["language_id"](spark, docs.unionByName(table), SF)) if r["doc_id"] >= 900_000}
    assert kept == set(range(len(junk), len(junk) + len(clean)))


def test_stages_take_odd_tables(spark):
    """Empty tables, nulls in any column, repeated rows, and columns that are called like those made on the way."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)
    for name, step in steps.items():
        assert step(spark, docs.limit(0), SF).count() == 0, name
    text = docs.filter("doc_id = 3").first()["text"]
    odd = spark.createDataFrame([(None, None, None, None, None), (None, text, None, None, None), (3, text, "en", None, 1), (3, text, "en", None, 1), (5, "", "en", "z", 0)], docs.schema)
    base = docs.limit(60).unionByName(odd)
    for c in ("__id", "__key", "__copies", "__lang", "score", "n_lines", "copies", "id", "size", "rank", "component_id"):
        base = base.withColumn(c, F.lit("own"))
    for name, step in steps.items():
        out = step(spark, base, SF)
        if name != "byte_bpe":
            assert out.columns == base.columns and out.filter("score = 'own' and __key = 'own' and __id = 'own'").count() == out.count(), name
    # A row that stands thrice is mixed thrice, each by its own draw.
    thrice = spark.createDataFrame([(i // 3, f"w{i // 3} " * 10, "en", "ab"[i % 2], 1) for i in range(90)], docs.schema)
    mixed = steps["mixing"](spark, thrice, SF)
    assert mixed.count() == sum(r["copies"] for r in rows(mixing.mix(thrice.withColumn("doc_id", F.monotonically_increasing_id()))))


def test_run(spark):
    """The tokens of the whole pipeline are those of its last stage's input."""
    import tiktoken

    path = corpus_pipeline.public_tokenizers.path("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=corpus_pipeline.public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(open(path, "rb").read()), special_tokens={})
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, step in corpus_pipeline.STAGES[:-1]:
        docs = stored(step(spark, docs, SF), "test_stage")
    want = sorted((r["doc_id"], np.array(library.encode_ordinary(r["text"]), dtype="<u4").tobytes()) for r in rows(docs))
    assert sorted((r["doc_id"], bytes(r["ids"])) for r in rows(corpus_pipeline.run(spark, SF))) == want


def test_one_line_passages_stay_once(spark):
    passage = " ".join(f"p{k}" for k in range(53))
    made = [(i, "\n".join(" ".join(f"u{i}.{j}.{k}" for k in range(20)) if j != 3 else passage for j in range(6)), "en", "z", 1) for i in range(1, 6)]
    docs = spark.createDataFrame(made, spark.read.parquet(f"{SF}/documents.parquet").schema)
    steps = dict(corpus_pipeline.STAGES)
    out = rows(steps["ngram_join"](spark, steps["line_dedup"](spark, docs, SF), SF))
    assert [r["doc_id"] for r in sorted(out, key=lambda r: r["doc_id"]) if passage in r["text"]] == [1] and len(out) == 5
    assert all(r["n_chars"] == len(r["text"]) and r["text"].count("\n") == (5 if r["doc_id"] == 1 else 4) for r in out)


def test_passages_are_found_without_shuffling_texts(spark):
    """Whole texts go through a shuffle twice in the stage of the join: as its result is made, and packed, as it verifies."""
    draw = np.random.default_rng(0)
    made = [(i, "\n".join(" ".join(draw.bytes(40).hex() for _ in range(25)) for _ in range(4)), "en", "z", 1) for i in range(800)]
    made += [(1000 + i, made[i][1] + " near", "en", "z", 1) for i in range(40)]
    docs = stored(spark.createDataFrame(made, spark.read.parquet(f"{SF}/documents.parquet").schema).repartition(4), "test_texts")
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()

    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
    try:
        start = written()
        out = stored(dict(corpus_pipeline.STAGES)["ngram_join"](spark, docs, SF), "test_joined")
        moved = written() - start
        start = written()
        docs.repartition(4, "doc_id").write.format("noop").mode("overwrite").save()
        once = written() - start
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert sorted(r["doc_id"] for r in rows(out)) == list(range(800))
    assert once > 0 and moved < 3 * once


def test_near_copies_are_those_of_five_words(spark):
    words = [f"n{k}" for k in range(124)]
    made = [words, words[:60] + ["changed"] + words[61:]]
    for n, at in ((84, (10, 60)), (60, (20,)), (50, (20,)), (44, (20,))):
        base = [f"m{n}.{k}" for k in range(n)]
        made += [base, [f"z{n}.{k}" if k in at else w for k, w in enumerate(base)]]
    docs = spark.createDataFrame([(i, " ".join(w), "en", "z", 1) for i, w in enumerate(made)], spark.read.parquet(f"{SF}/documents.parquet").schema)

    def close(a, b):
        x, y = ({tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in (a, b))
        return 5 * len(x & y) >= 4 * len(x | y)

    want = {i for i in range(len(made)) if not any(close(made[i], made[j]) for j in range(i))}
    assert {r["doc_id"] for r in rows(dict(corpus_pipeline.STAGES)["ngram_join"](spark, docs, SF))} == want
    # Four words and 0.85 would give other links.
    assert want != {i for i, (_, c) in brute_components((i, " ".join(w)) for i, w in enumerate(made)).items() if i == c}


def test_one_row_of_each_component_stays(spark):
    texts = [" ".join(f"{c}{k}" for k in range(30)) for c in "abc"]
    made = [(1, texts[0]), (1, texts[0]), (2, texts[0]), (None, texts[0]), (None, texts[1]), (None, texts[1]), (None, texts[2]), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "z", 1) for i, t in made], spark.read.parquet(f"{SF}/documents.parquet").schema)
    out = rows(dict(corpus_pipeline.STAGES)["ngram_join"](spark, docs, SF))
    want = [(1, texts[0]), (None, texts[1]), (None, texts[2]), (None, None)]
    assert sorted(((r["doc_id"], r["text"]) for r in out), key=str) == sorted(want, key=str)
