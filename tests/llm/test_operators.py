"""Operators against brute-force versions on a small table with every odd case, and on the smallest test tables."""

import hashlib
import itertools
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from sievelake.llm import brown_lm, byte_bpe, exact_dedup, fingerprints, langid, licenses, line_dedup, mixing, ngram_join, shared, token_files
from sievelake.llm.components import components

SF = "/root/testdata/sf0.001"
WORDS = [f"w{i}" for i in range(400)]


def _text(seed, n):
    r = np.random.default_rng(seed)
    return " ".join(WORDS[i] for i in r.integers(0, 400, n))


LONG = _text(1, 300)
ROWS = [
    (1, LONG, "en", "a", "x"),
    (2, LONG.replace("w1 ", "w1  \n"), "en", "a", "x"),  # equal but for white space
    (3, LONG + " tail", "en", None, "x"),  # near copy
    (4, "head " + LONG + " tail", "fr", "b", "x"),
    (5, None, None, None, None),
    (6, "", "en", "a", "x"),
    (7, " \t\n", "en", "a", "x"),
    (8, "one two", "de", "b", "x"),
    (9, "ONE  two", "de", "b", "x"),
    (10, "123 456 !!", "de", "b", "x"),
    (11, "Released under the MIT License. All rights reserved. CC-BY 4.0", "en", "a", "x"),
    (12, "This work is licensed under the GNU General Public License, version 3.", "en", "a", "x"),
    (13, _text(2, 4000), "fr", "c", "x"),  # long
    (14, _text(3, 50), "fr", "c", "x"),
    (14, _text(3, 50), "fr", "c", "x"),  # a row repeated
    (15, "l1\nl2 x\nl3\nl4\nl5\nl6\nl7\nl8", "en", "a", "x"),
    (16, "other\nl1\nl2 x\nl3\nl4\nl5\nl6\nl7\nl8\nend", "en", "a", "x"),
    (17, "Straße ÉCOLE ﬁn", "fr", "c", "x"),
    (18, "strasse  école fin", "fr", "c", "x"),
    (19, "日本語 テスト <|endoftext|> it's 12345 \x1cx", "ja", "c", "x"),
]
NAMES = "doc_id bigint, text string, lang string, source string, n_chars string"


@pytest.fixture(scope="module")
def docs(spark):
    """Columns beside the needed ones have names that operators use inside themselves, too."""
    df = spark.createDataFrame(ROWS, NAMES).repartition(3)
    for c in ("id", "size", "key", "digest", "body", "n", "row"):
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_exact_dedup(docs, empty):
    got = {r["doc_id"]: r for r in rows(exact_dedup.exact_dedup(docs))}
    norm = {i: re.sub(r"[\x20\x09-\x0D]", "", t or "") for i, t, *_ in ROWS}
    for i, t, *_ in ROWS:
        same = [(-len(u or ""), j) for j, u, *_ in ROWS if norm[j] == norm[i]]
        assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (min(same)[1], len(same), min(same)[1] == i)
        assert got[i]["text_sha256"] == hashlib.sha256(norm[i].encode()).hexdigest()
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_exact_dedup_tells_texts_of_one_digest_apart(spark, monkeypatch):
    real = F.sha2
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda c, n: real(F.substring(c, 1, 1), n))
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in rows(exact_dedup.exact_dedup(spark.createDataFrame([(1, "ab"), (2, "a b"), (3, "ac"), (4, "d")], "doc_id bigint, text string")))}
    assert got == {1: (2, 2), 2: (2, 2), 3: (3, 1), 4: (4, 1)}


def test_exact_dedup_null_id(spark):
    df = spark.createDataFrame([(None, "ab"), (2, "a b"), (None, "q")], "doc_id bigint, text string")
    assert sorted((r["keep_id"] or -1, r["kept"]) for r in rows(exact_dedup.exact_dedup(df))) == [(-1, True), (2, False), (2, True)]


def test_fingerprints(docs, empty):
    got = sorted(rows(fingerprints.fingerprint_documents(docs)), key=lambda r: r["doc_id"])
    ordered = sorted(((i, t or "") for i, t, *_ in ROWS), key=lambda x: x[0])
    assert len(got) == len(ordered)
    for k, (r, (i, t)) in enumerate(zip(got, ordered)):
        other = ordered[(k + 1) % len(ordered)][1]
        half = len(t) // 2
        new = t[: len(t) - half] + other[:half]
        assert (r["doc_id"], r["n_chars"], r["edited_sha256"]) == (i, len(t), hashlib.sha256(new.encode()).hexdigest())
        assert r["near_edited"] == float(fingerprints.canonical(t) == fingerprints.canonical(new))
        assert r["near_next"] == float(fingerprints.canonical(t) == fingerprints.canonical(other))
        assert (r["fingerprint"] == r["edited_fingerprint"]) == bool(r["near_edited"])
    by = {r["doc_id"]: r["fingerprint"] for r in got}
    assert by[17] == by[18] and by[8] == by[9] and by[5] == by[6] == by[7] and len(set(by.values())) < len(by)
    assert fingerprints.fingerprint_documents(empty).count() == 0


def test_fingerprints_tell_forms_of_one_digest_apart(spark):
    """With a digest that is one for all: rows without an id, and rows that share one, are neither lost nor multiplied."""
    made = [(1, "a"), (2, "b"), (3, "A "), (None, "b"), (None, "c"), (2, "b"), (7, "c")]
    df = spark.createDataFrame(made, "doc_id bigint, text string").repartition(3)
    same = lambda form: "same"  # noqa: E731  goes to the workers by value
    assert sorted((r["first_id"], r["group_size"]) for r in rows(fingerprints.group(df, hashed=same))) == [(1, 2), (2, 3), (7, 2)]
    got = sorted(((r["doc_id"], r["fingerprint"], r["first_id"], r["group_size"]) for r in rows(fingerprints.fingerprint_documents(df, hashed=same))), key=str)
    assert got == sorted([(1, "same", 1, 2), (3, "same", 1, 2), (2, "same-1", 2, 3), (2, "same-1", 2, 3), (None, "same-1", 2, 3), (None, "same-2", 7, 2), (7, "same-2", 7, 2)], key=str)


def test_copies_of_hot_groups_are_salted(spark, monkeypatch):
    monkeypatch.setattr(shared, "HOT_ROWS", 3)
    made = [(i, "the same" if i % 3 else f"own {i}") for i in range(60)]
    df = spark.createDataFrame(made, "doc_id bigint, text string").repartition(4)
    for f in (exact_dedup.exact_dedup, fingerprints.fingerprint_documents):
        assert {r["doc_id"]: r["group_size"] for r in rows(f(df))} == {i: 40 if i % 3 else 1 for i, _ in made}


def water_fill(sizes, weights, total, most):
    target, open_ = {}, set(sizes)
    left = total
    while open_:
        w = sum(weights[s] for s in open_)
        over = {s for s in open_ if left * weights[s] / w > most * sizes[s]}
        if not over:
            return target | {s: left * weights[s] / w for s in open_}
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= over
    return target


@pytest.mark.parametrize("which", ["docs", "small"])
def test_mixing(which, request, empty):
    df = request.getfixturevalue(which)
    got = rows(mixing.mix(df))
    source = [(r["doc_id"], r["source"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))) for r in rows(df.select("doc_id", "source", "text"))]
    sizes = {}
    for _, s, n in source:
        sizes[s] = sizes.get(s, 0) + n
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    want = water_fill(sizes, weights, 1.5 * sum(sizes.values()), 2)
    by_id = {}
    for i, s, n in source:
        by_id.setdefault(i, (s, n))
    taken = {}
    for r in got:
        s, n = by_id[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (n, sizes[s]) and r["target"] == pytest.approx(want[s], abs=1e-6)
        assert 0 <= r["taken"] <= 2 * n and (n == 0 or r["taken"] % n == 0)
        taken[s] = taken.get(s, 0) + r["taken"]
    for s in sizes:
        mine = [n for _, t, n in source if t == s]
        assert taken[s] <= want[s] + 1e-6 and want[s] - taken[s] <= max(mine)
    assert sorted(map(str, got)) == sorted(map(str, rows(mixing.mix(df.repartition(2)))))
    assert mixing.mix(empty).count() == 0


def test_mixing_weights_change_odds(spark):
    df = spark.createDataFrame([(i, "a b c", "s", 9.0 if i % 2 else 1.0) for i in range(400)] + [(1000, "x " * 3000, "t", 1.0)], "doc_id bigint, text string, source string, w double")
    got = rows(mixing.mix(df, weight_col="w", weights=(1.0, 3.0), share=0.2))
    heavy = sum(r["taken"] for r in got if r["doc_id"] % 2 and r["doc_id"] < 1000)
    assert heavy > 2 * sum(r["taken"] for r in got if r["doc_id"] % 2 == 0 and r["doc_id"] < 1000)


def pareto_ranks(docs, wanted, u):
    """Rank of each document (size, weight): inclusion in proportion to weight, whole ones taken out one by one."""
    rest, left, whole = dict(docs), wanted, set()
    while True:
        total = sum(n * w for n, w in rest.values())
        over = {i for i, (_, w) in rest.items() if total and w * left / total >= 1}
        if not over:
            break
        whole |= over
        left = max(0.0, left - sum(rest.pop(i)[0] for i in over))
    p = {i: min(max(w * left / total if total else 0.0, 1e-9), 1 - 1e-9) for i, (_, w) in rest.items()}
    return {i: 0.0 if i in whole else u[i] / (1 - u[i]) / (p[i] / (1 - p[i])) for i in docs}


def test_mixing_takes_the_documents_of_the_order(spark):
    """The chosen set by brute force, with weights of which some make a copy certain, some are none."""
    r = np.random.default_rng(4)
    made = [(i, "w " * int(r.integers(0, 90)), "ab"[i % 2], float(w) if w else None) for i, w in enumerate(r.choice([0, 1, 2, 5, 60], 300))]
    df = spark.createDataFrame(made, "doc_id bigint, text string, source string, w double").repartition(3)
    got = {x["doc_id"]: x for x in rows(mixing.mix(df, weight_col="w", weights=(2.0, 1.0), share=0.9, seed=8))}
    u = {x["doc_id"]: x["u"] for x in rows(df.select("doc_id", mixing.unit_random(8, F.col("doc_id"), F.col("text")).alias("u")))}
    for s in "ab":
        mine = [i for i, _, t, _ in made if t == s]
        certain = int(got[mine[0]]["target"] / got[mine[0]]["source_size"] + 1e-12)
        left = got[mine[0]]["target"] - certain * got[mine[0]]["source_size"]
        rank = pareto_ranks({i: (got[i]["size"], made[i][3] or 0.0) for i in mine}, left, u)
        assert 0 < sum(x == 0 for x in rank.values()) < len(rank)
        for i in sorted((i for i in mine if got[i]["size"]), key=rank.get):
            fits = got[i]["size"] <= left
            assert got[i]["copies"] == certain + fits, (i, rank[i])
            left -= got[i]["size"] * fits


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mixing_goes_on_behind_documents_that_do_not_fit(spark, seed):
    """Sources that one document dominates, held against a walk down the order."""
    sizes = {"a": [20_000] + [100] * 300, "b": [200] * 100 + [20_000], "c": [5_000, 3_000, 900] + list(range(1, 60)), None: [7, 400, 30]}
    made = [(k, "w " * n, s) for k, (s, n) in enumerate((s, n) for s, many in sizes.items() for n in many)]
    df = spark.createDataFrame(made, "doc_id bigint, text string, source string").repartition(4)
    got = {r["doc_id"]: r for r in rows(mixing.mix(df, weights=(1.0,), share=0.56, seed=seed))}
    u = {r["doc_id"]: r["u"] for r in rows(df.select("doc_id", mixing.unit_random(seed, F.col("doc_id"), F.col("text")).alias("u")))}
    for s in sizes:
        mine = [i for i in got if made[i][2] == s]
        certain = min(got[i]["copies"] for i in mine)
        left = got[mine[0]]["target"] - certain * got[mine[0]]["source_size"]
        rank = pareto_ranks({i: (got[i]["size"], np.log1p(got[i]["size"])) for i in mine}, left, u)
        mine.sort(key=rank.get)
        for i in mine:
            fits = got[i]["size"] <= left
            assert got[i]["copies"] == certain + fits
            left -= got[i]["size"] * fits


def brute_sets(text):
    w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set()


def brute_components(pairs):
    sets = {i: brute_sets(t) for i, t in pairs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("hot", [512, 2])
@pytest.mark.parametrize("which", ["docs", "small"])
def test_ngram_join(which, hot, request, empty, monkeypatch):
    """Also with nearly all buckets taken for large ones, and nearly all keys for hot ones."""
    monkeypatch.setattr(ngram_join, "HOT_BUCKET", hot)
    monkeypatch.setattr(shared, "HOT_ROWS", hot)
    monkeypatch.setattr(shared, "MOST_HOT", 10**9 // hot)
    df = request.getfixturevalue(which)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows(ngram_join.ngram_join(df, words=4, threshold=85))}
    assert got == brute_components([(r["doc_id"], r["text"]) for r in rows(df.select("doc_id", "text"))])
    assert ngram_join.ngram_join(empty).count() == 0


@pytest.mark.parametrize("hot", [512, 1])
def test_ngram_join_with_frequent_shingles(spark, monkeypatch, hot):
    """Chains of near copies of all lengths, where nearly every shingle counts as frequent."""
    r = np.random.default_rng(7)
    made = []
    for n in (4, 9, 25, 40, 120, 400):
        words = [WORDS[i] for i in r.integers(0, 400, n)]
        for k in range(9):
            words = words[:]
            for _ in range(int(r.integers(0, max(2, n // 45)))):
                words[int(r.integers(0, n))] = f"z{n}.{k}.{int(r.integers(0, 99))}"
            made.append(" ".join(words))
    df = spark.createDataFrame(list(enumerate(made)), "doc_id bigint, text string").repartition(5)
    monkeypatch.setattr(ngram_join, "FREQUENT", 0)
    monkeypatch.setattr(ngram_join, "HOT_BUCKET", hot)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in rows(ngram_join.ngram_join(df, words=4, threshold=85))}
    assert got == brute_components(enumerate(made))


def test_signatures_meet_whenever_sets_link():
    r = np.random.default_rng(3)
    counters = r.integers(0, 40, 1 << 12).astype(np.uint32)
    for n in [*range(1, 60), 97, 150, 333, 1000]:
        for _ in range(4):
            a = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
            gone = int(r.integers(0, ngram_join.slack(n, 85) + 1))
            keep = r.permutation(a)[gone:]
            room = 100 * keep.size // 85 - a.size
            b = np.unique(np.concatenate([keep, r.integers(0, 2**63, max(0, int(r.integers(0, room + 1)))).astype(np.uint64)]))
            both = np.intersect1d(a, b).size
            if 100 * both >= 85 * (a.size + b.size - both):
                for frequent in (-1, 5, 20, 100):
                    (x, _), (y, _) = (ngram_join.signatures(s, counters, frequent, 85) for s in (a, b))
                    assert np.intersect1d(x, y).size, (n, frequent)


def test_ngram_join_takes_no_hash_for_a_word(spark):
    """Thue-Morse words, which polynomial hashes modulo a power of two take for one another, and null ids."""
    one = "".join("ab"[bin(i).count("1") & 1] for i in range(1024))
    two = one.translate({97: 98, 98: 97})
    made = [(1, one), (2, two), (3, "x y z " + one), (4, "x y z " + two), (5, "X\ty z  " + two), (None, one), (None, "only here"), (None, "only here")]
    got = rows(ngram_join.ngram_join(spark.createDataFrame(made, "doc_id bigint, text string"), words=4, threshold=85))
    assert sorted(((r["doc_id"], r["component_id"]) for r in got), key=str) == sorted([(1, 1), (2, 2), (3, 3), (4, 4), (5, 4), (None, 1), (None, None), (None, None)], key=str)


def test_pairs_are_verified_by_words():
    words = [f"w{k}".encode() for k in range(60)]
    assert ngram_join.linked(words, words[:-2], 4, 85) and not ngram_join.linked(words, words[:-20], 4, 85)
    assert not ngram_join.linked([], [], 4, 85) and ngram_join.linked(words[:2], words[:2], 4, 85) and not ngram_join.linked(words[:2], words[:3], 4, 85)


@pytest.mark.parametrize("hot", [1000, 1])
def test_components(spark, monkeypatch, hot):
    """A chain, a star, a pair, a link of a node with itself; also with every key taken for a hot one."""
    monkeypatch.setattr(shared, "HOT_ROWS", hot)
    monkeypatch.setattr(shared, "MOST_HOT", 10**9)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (103, 101), (7, 7)] + [(200, 201 + k) for k in range(50)] + [(200, 201)]
    got = {r["node"]: r["label"] for r in rows(components(spark.createDataFrame(links, "a bigint, b bigint")))}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 103: 100, **{200 + k: 200 for k in range(51)}}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_langid(docs, small, empty):
    train = small.filter(langid.fold("doc_id", 5) != 0)
    prototypes = langid.train(train)
    assert sorted(prototypes) == ["de", "en", "es", "fr"]
    got = small.select("doc_id", "lang").join(langid.predict(small, prototypes), "doc_id").filter(langid.fold("doc_id", 5) == 0)
    assert got.filter("lang = lang_pred").count() >= 0.97 * got.count()
    assert got.filter("score < 0 or score > 1").count() == 0
    found = {r["doc_id"]: r for r in rows(langid.predict(docs, prototypes))}
    assert all(found[i]["lang_pred"] == "und" and found[i]["score"] == 0 for i in (5, 6, 7, 10))
    assert langid.predict(empty, prototypes).count() == 0 and langid.train(empty) == {}
    assert {r["lang_pred"] for r in rows(langid.predict(docs, {}))} == {"und"}


def test_langid_by_brute_force(small, docs):
    """Prototypes and predictions from single trigrams, one text at a time; with a tie and a language of one text."""
    dims, held = 128, {}
    spark = small.sparkSession
    made = [(10_000 + r["doc_id"], r["text"], r["lang"]) for r in rows(small.limit(70))] + [(r["doc_id"], r["text"], r["lang"]) for r in rows(docs.select("doc_id", "text", "lang"))]
    made += [(5000, "qqq zzz", "b"), (5001, "qqq zzz", "a"), (5002, "qqq zzz", None), (5003, None, "c"), (5004, "12 !", "d")]
    df = spark.createDataFrame(made, "doc_id bigint, text string, lang string").repartition(3)

    def vector(text):
        letters = [ord(c) if c.isalpha() else 0 for c in (text or "").lower()]
        symbols = [0]
        for c in letters + [0]:
            if c or symbols[-1]:
                symbols.append(c)
        out = np.zeros(dims)
        for tri in zip(symbols, symbols[1:], symbols[2:]):
            if tri not in held:
                a, b, c = (langid.space(dims).rows(np.array([x])).astype(float)[0] for x in tri)
                held[tri] = np.roll(a, 2) * np.roll(b, 1) * c
            out += held[tri]
        return out

    vectors = [vector(t) for _, t, _ in made]
    sums = {}
    for v, (_, t, lang) in zip(vectors, made):
        if lang is not None and t is not None:
            sums[lang] = sums.get(lang, 0) + v
    want = {}
    for v, (i, _, _) in zip(vectors, made):
        cosine = {k: v @ p / np.linalg.norm(v) / np.linalg.norm(p) for k, p in sums.items() if p.any()} if v.any() else {}
        best = max(cosine.values(), default=0.0)
        want[i] = (min((k for k, c in cosine.items() if c > best - 1e-9), default="und"), min(1.0, max(0.0, best)))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in rows(langid.predict(df, langid.train(df, dims=dims)))}
    assert {i: g[0] for i, g in got.items()} == {i: w[0] for i, w in want.items()} and want[5002][0] == "a" and want[5004][0] == "und"
    assert all(got[i][1] == pytest.approx(want[i][1], abs=1e-9) for i in want)


def test_langid_vectors_are_the_bound_letters():
    dims = 64
    codes, counts = langid.trigrams("ab, c")
    a, b, c, gap = (langid.space(dims).rows(np.array([ord(x) if x else 0])).astype(int)[0] for x in ("a", "b", "c", ""))
    tri = lambda x, y, z: np.roll(x, 2) * np.roll(y, 1) * z
    want = tri(gap, a, b) + tri(a, b, gap) + tri(b, gap, c) + tri(gap, c, gap)
    assert counts.sum() == 4 and (langid.bundle([(codes, counts)], np.array([0]), 1, dims)[0] == want).all()


def brute_lines(pairs, every=line_dedup.EVERY, least=line_dedup.MIN_LINES):
    seen, out = set(), {}
    for i, t in sorted(pairs):
        lines = t.split("\n")
        h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
        chunks, held = [], []
        for k, line in enumerate(lines):
            held.append(line)
            if (h[k] + line_dedup.FACTOR * (h[k - 1] if k else 0)) % every == 0 or k == len(lines) - 1:
                chunks.append(held)
                held = []
        kept, gone = [], 0
        for c in chunks:
            body = "\n".join(c)
            if len(c) >= least and body.strip(" \t\n\r\x0b\x0c") and body in seen:
                gone += len(c)
                continue
            if len(c) >= least:
                seen.add(body)
            kept.append(body)
        out[i] = (len(lines), gone, "\n".join(kept))
    return out


@pytest.mark.parametrize("hot", [1000, 1])
@pytest.mark.parametrize("which", ["docs", "small"])
def test_line_dedup(which, hot, request, empty, monkeypatch):
    monkeypatch.setattr(shared, "HOT_ROWS", hot)
    df = request.getfixturevalue(which)
    got = {r["doc_id"]: (r["n_lines"], r["lines_removed"], r["text"]) for r in rows(line_dedup.line_dedup(df))}
    texts = {r["doc_id"]: r["text"] for r in rows(df.select("doc_id", "text"))}
    want = brute_lines([(i, t) for i, t in texts.items() if t is not None])
    assert {i: got[i] for i in want} == want and sum(x[1] for x in want.values()) > 0
    assert all(got[i] == (0, 0, None) for i, t in texts.items() if t is None)
    assert line_dedup.line_dedup(df).count() == df.count()
    assert line_dedup.line_dedup(empty).count() == 0


def test_line_dedup_keeps_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b\nc d\ne f", 7, "k", "g"), (2, "x", 8, None, "h")], "doc_id bigint, text string, n_lines int, __key string, __gone string")
    got = sorted(rows(line_dedup.line_dedup(df, report=False)), key=lambda r: r["doc_id"])
    assert [(r["n_lines"], r["__key"], r["__gone"]) for r in got] == [(7, "k", "g"), (8, None, "h")]
    assert [r["n_lines"] for r in sorted(rows(line_dedup.line_dedup(df)), key=lambda r: r["doc_id"])] == [3, 1]
    assert [(r["n_lines"], r["__key"], r["__gone"]) for r in sorted(rows(line_dedup.drop_passages(df)), key=lambda r: r["doc_id"])] == [(7, "k", "g"), (8, None, "h")]
    assert rows(langid.predict(df.withColumn("score", F.lit("own")), {}, keep=tuple([*df.columns, "score"]), named=("a", "b")))[0]["score"] == "own"
    assert rows(langid.predict(df.withColumn("score", F.lit("own")), {}, keep=("doc_id", "score")))[0]["score"] == 0.0


def brute_passages(pairs, least):
    """All runs of lines that have enough words, of any length, not the shortest ones alone."""
    texts = {i: [(k, x) for k, x in enumerate(t.split("\n")) if x.strip(" \t\n\r\x0b\x0c")] for i, t in pairs}
    seen, out = {}, {}
    for i in sorted(texts):
        own, gone = texts[i], set()
        for a in range(len(own)):
            for b in range(a + 1, len(own) + 1):
                body = tuple(x for _, x in own[a:b])
                if sum(len(x.split()) for x in body) >= least:
                    j, c = seen.setdefault(body, (i, a))
                    if j < i or a - c >= b - a:
                        gone |= {k for k, _ in own[a:b]}
        out[i] = gone
    return {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in out[i]) for i, t in pairs}


def test_drop_passages(spark):
    long, other = "a passage of nine words on one line only", "another line that has nine words, all on it"
    made = [
        (1, f"one\n{long}\ntwo"),
        (2, f"three\n{long}\nfour\n\n{other}"),  # one line alone
        (3, f"{other}\nfive six\nseven\n{long}\nend"),
        (4, f"start\n{other}\nfive six\nseven\nrest"),  # short lines behind a long one
        (5, "b1 b2 b3\nb4 b5\n \nb6 b7 b8"),
        (6, "x\nb1 b2 b3\nb4 b5\nb6 b7 b8\ny"),  # only together enough
        (7, "five six\nb4 b5\nseven"),  # too few
        (8, "\n".join(["q q q q"] * 7)),  # itself again and again
        (9, long),
        (None, f"{long}\nnull"),
        (10, None),
    ]
    df = spark.createDataFrame(made, "doc_id bigint, text string").repartition(3)
    got = {r["doc_id"]: r["text"] for r in rows(line_dedup.drop_passages(df))}
    assert got[2] == f"three\nfour\n\n{other}" and got[3] == "five six\nseven\nend" and got[4] == "start\nrest"
    assert got[6] == "x\ny" and got[7] == made[6][1] and got[8] == "q q q q\nq q q q" and got[9] == "" and got[None] == "null" and got[10] is None
    assert len(got) == len(made)


@pytest.mark.parametrize("least,hot", [(5, 1000), (8, 2)])
def test_drop_passages_finds_all_runs(spark, monkeypatch, least, hot):
    monkeypatch.setattr(shared, "HOT_ROWS", hot)
    r = np.random.default_rng(11)
    pool = [" ".join([f"p{k}"] * int(r.integers(1, 7))) for k in range(5)]
    made = [(i, "\n".join(pool[k] if k < 5 else f"only {i}" for k in r.integers(0, 7, 9))) for i in range(25)]
    got = {x["doc_id"]: x["text"] for x in rows(line_dedup.drop_passages(spark.createDataFrame(made, "doc_id bigint, text string"), least_words=least))}
    # A long run that overlaps its first occurrence holds shorter ones that don't, so nothing else differs between documents.
    want = brute_passages(made, least)
    assert got == want and got != dict(made)


@pytest.mark.parametrize("hot", [1000, 2])
def test_drop_passages_among_some_rows(spark, monkeypatch, hot):
    """The others neither come back nor hold a first occurrence."""
    monkeypatch.setattr(shared, "HOT_ROWS", hot)
    r = np.random.default_rng(12)
    made = [(i, "\n".join(f"p{k} " * (k + 3) if k < 5 else f"only {i}" for k in r.integers(0, 7, 9))) for i in range(25)]
    some = [x for x in made if x[0] % 3]
    df, ids = spark.createDataFrame(made, "doc_id bigint, text string"), spark.createDataFrame([x[:1] for x in some], "own bigint")
    got = {x["doc_id"]: x["text"] for x in rows(line_dedup.drop_passages(df, least_words=5, among=ids))}
    whole = brute_passages(made, 5)
    assert got == brute_passages(some, 5) and got != {i: whole[i] for i, _ in some}


def test_byte_bpe(docs, small, empty):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = byte_bpe.load_ranks(open(path, "rb").read())
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for df in (docs, small):
        texts = {r["doc_id"]: r["text"] or "" for r in rows(df.select("doc_id", "text"))}
        for r in rows(byte_bpe.byte_bpe(df, path, public_tokenizers.PATTERN, keep=("ids", "decoded", "ids_sha256", "decoded_sha256"))):
            want = library.encode_ordinary(texts[r["doc_id"]])
            assert np.frombuffer(r["ids"], "<u4").tolist() == want and r["n_tokens"] == len(want)
            assert bytes(r["decoded"]).decode() == texts[r["doc_id"]]
            assert r["ids_sha256"] == hashlib.sha256(r["ids"]).hexdigest() and r["decoded_sha256"] == hashlib.sha256(r["decoded"]).hexdigest()
    assert byte_bpe.byte_bpe(empty, path, public_tokenizers.PATTERN).count() == 0


def test_byte_bpe_of_very_long_texts_and_small_tables(spark, monkeypatch):
    """Texts of many slices, one giant pre-token, and a table that forgets again and again; the workers are one process's children."""
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    data = open(path, "rb").read()
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(data), special_tokens={})
    monkeypatch.setattr(byte_bpe, "KNOWN", 40)
    monkeypatch.setattr(byte_bpe, "PIECE", 7)
    monkeypatch.setattr(byte_bpe, "SLICE", 3000)
    work = byte_bpe._Encode(type("Sent", (), {"value": data}), public_tokenizers.PATTERN, "id", "text", ("ids", "decoded"))
    work.start()
    for made in (["", None, _text(5, 90), "x" * 70 + " a b"], [_text(6, 20_000) + " 日本 " + "ab" * 50_000], [_text(7, 3000)]):
        out = work(byte_bpe.pa.RecordBatch.from_pydict({"id": list(range(len(made))), "text": made}))
        for t, ids, back in zip(made, out["ids"], out["decoded"]):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(t or "") and back.decode() == (t or "")
    assert len(work.known.new) + len(work.known.old) <= 40 + len(set(work.split(made[0]))) and max(map(len, work.known.new)) <= byte_bpe.WIDE


def test_segment_trees_agree():
    ranks = byte_bpe.load_ranks(open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read())
    tree = byte_bpe.SegmentTreeBPE(ranks)
    r = np.random.default_rng(0)
    words = [bytes(r.choice([97, 98, 32, 195, 169, 120], int(n))) for n in r.integers(2, 64, 300)] + [b"a" * n for n in (2, 3, 63, 64)]
    words = [w for w in words if w not in ranks]
    assert tree.encode_words(words) == [tree.encode_long(w).astype("<u4").tobytes() for w in words]


def test_licenses(docs, empty):
    got = {r["doc_id"]: r for r in rows(licenses.scan(docs))}
    for i, t, *_ in ROWS:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        at, named = [], set()
        for label, phrase in licenses.BASE.items():
            p = phrase.split()
            found = [k for k in range(len(words)) if words[k : k + len(p)] == p]
            at += found
            named |= {label} if found else set()
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(named)))
        assert named <= set(r["labels"].split(",")) | {""} and 0 <= r["score"] <= 1
    assert got[11]["labels"] == "cc-by,mit,reserved" and got[12]["labels"] == "gpl,gpl-3.0" and got[12]["score"] == 1.0
    assert licenses.scan(empty).count() == 0


@pytest.mark.parametrize(
    "template,text,end",
    [
        ("a b", "a b c", 2), ("a b", "a x b", -1), ("a <<beginOptional>>x y<<endOptional>> b", "a x y b", 4), ("a <<beginOptional>>x y<<endOptional>> b", "a b", 2),
        ("a <<beginOptional>>x y<<endOptional>> b", "a x b", -1), ("a <<var;min=0;max=2>> b", "a b", 2), ("a <<var;min=0;max=2>> b", "a q r b", 4), ("a <<var;min=0;max=2>> b", "a q r s b", -1),
        ("a <<var;min=1;max=2>> b", "a b", -1), ("a <<beginOptional>>x <<beginOptional>>y<<endOptional>><<endOptional>> b", "a x b", 3), ("<<beginOptional>>x<<endOptional>> a", "x a", 2),
    ],
)
def test_template_automata(template, text, end):
    assert licenses.Automaton(template).longest([w.encode() for w in text.split()], 0) == end


def template_pattern(template):
    """The template as a regular expression over words that each end with a blank."""
    out = ""
    for mark, low, high, word in re.findall(r"<<(beginOptional|endOptional|var;min=(\d+);max=(\d+))>>|([0-9A-Za-z]+)", template):
        out += {"beginOptional": "(?:", "endOptional": ")?"}.get(mark) or (f"{word.lower()} " if word else f"(?:[^ ]+ ){{{low},{high}}}")
    return re.compile(out)


def brute_spans(pattern, words):
    """Leftmost, longest: every start, and of it every end."""
    found, at = [], 0
    while at < len(words):
        ends = [j for j in range(at + 1, len(words) + 1) if pattern.fullmatch("".join(f"{w} " for w in words[at:j]))]
        if ends:
            found.append((at, ends[-1]))
        at = ends[-1] if ends else at + 1
    return found


def some_wording(template, r):
    """A text that the template accepts, its regions drawn at random."""
    out, skipped, opened = [], 0, []
    for mark, low, high, word in re.findall(r"<<(beginOptional|endOptional|var;min=(\d+);max=(\d+))>>|([0-9A-Za-z]+)", template):
        if mark == "beginOptional":
            opened.append(bool(r.integers(0, 2)))
            skipped += opened[-1]
        elif mark == "endOptional":
            skipped -= opened.pop()
        elif not skipped:
            out += [word] if word else [f"v{r.integers(0, 9)}"] * int(r.integers(int(low), int(high) + 1))
    return out


def test_licenses_by_brute_force(spark):
    """Labels, spans and score of texts made from all templates, whole, spoilt and mixed with other words."""
    r = np.random.default_rng(2)
    made = []
    for label, template in licenses.TEMPLATES.items():
        for k in range(4):
            words = some_wording(template, r)
            if k == 3:
                words[int(r.integers(0, len(words)))] = "spoilt"
            made.append((len(made), " ".join(["Before, it"] * int(r.integers(0, 3)) + words + ["(after)"] * int(r.integers(0, 3)))))
    made += [(1000, "This work is licensed under the GNU General Public License, version 3. All rights reserved"), (1001, None), (1002, "")]
    got = {x["doc_id"]: x for x in rows(licenses.scan(spark.createDataFrame(made, "doc_id bigint, text string")))}
    every = {**licenses.TEMPLATES, **licenses.BASE}
    patterns, whole = {k: template_pattern(v) for k, v in every.items()}, 0
    for i, t in made:
        words = re.findall(r"[0-9a-z]+", (t or "").lower())
        want = [(k, a, b) for k, p in patterns.items() for a, b in brute_spans(p, words)]
        assert sorted((x["label"], x["first"], x["end"]) for x in got[i]["spans"]) == sorted(want)
        assert got[i]["labels"] == ",".join(sorted({k for k, _, _ in want}))
        covered = set().union(*(range(a, b) for _, a, b in want))
        assert got[i]["score"] == (len(covered) / len(words) if words else 0.0)
        whole += any(k.endswith("-text") for k, _, _ in want)
    assert whole >= 15


def test_templates_must_be_well_formed():
    for bad in ("a <<beginOptional>> b", "<<beginOptional>>a<<endOptional>>", "a <<what>> b"):
        with pytest.raises(ValueError):
            licenses.Automaton(bad)


def test_token_files(spark, docs, small, empty, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    for k, df in enumerate((docs, small)):
        token_files.write_token_files(df, path, f"{tmp_path}/{k}", end_id=2)
        got = sorted(rows(token_files.read_token_files(spark, f"{tmp_path}/{k}", keep=("ids", "ids_crc32"))), key=lambda r: r["start"])
        texts = sorted((r["doc_id"], r["text"] or "") for r in rows(df.select("doc_id", "text")))
        start = 0
        assert len(got) == len(texts)
        for r, (i, t) in zip(got, texts):
            want = library.encode(t, add_special_tokens=False).ids + [2]
            assert (r["doc_id"], r["start"], r["n_tokens"]) == (i, start, len(want)) and np.frombuffer(r["ids"], "<u4").tolist() == want
            assert r["ids_crc32"] == zlib.crc32(r["ids"])
            start += len(want)
    token_files.write_token_files(empty, path, f"{tmp_path}/none", end_id=2)
    assert token_files.read_token_files(spark, f"{tmp_path}/none").count() == 0


def test_rows_without_id_and_long_texts(spark, tmp_path):
    """Null ids come first or last as the docstrings say, repeated rows come out repeated, a text of megabytes is whole."""
    path = public_tokenizers.path("word_bpe_49k.json")
    long = "many words of one text " * 60_000
    made = [(None, "b a"), (None, "b a"), (None, None), (4, long), (4, long), (-3, "x")]
    df = spark.createDataFrame(made, "doc_id bigint, text string").repartition(3)
    token_files.write_token_files(df, path, f"{tmp_path}/ids", end_id=2)
    got = sorted(rows(token_files.read_token_files(spark, f"{tmp_path}/ids", keep=("ids",))), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, None, None, -3, 4, 4] and got[-1]["n_tokens"] > 60_000 and got[-1]["ids"] == got[-2]["ids"]
    two = sorted(rows(fingerprints.fingerprint_documents(df)), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["n_chars"]))
    assert [(r["doc_id"], r["n_chars"]) for r in two] == [(None, 0), (None, 3), (None, 3), (-3, 1), (4, len(long)), (4, len(long))]
    lines = spark.createDataFrame([(None, "p q\nr s\nt u\nv"), (2, "p q\nr s\nt u\nv"), (2, "p q\nr s\nt u\nv")], "doc_id bigint, text string")
    out = [(r["doc_id"], r["text"]) for r in rows(line_dedup.line_dedup(lines, every=1000))]
    assert sorted(out, key=str) == sorted([(None, ""), (2, "p q\nr s\nt u\nv"), (2, "p q\nr s\nt u\nv")], key=str)
    mixed = rows(mixing.mix(df.withColumn("source", F.lit(None).cast("string"))))
    assert len(mixed) == 6 and all(r["taken"] == r["copies"] * r["size"] for r in mixed)
    near = rows(ngram_join.ngram_join(df))
    assert sorted(((r["doc_id"], r["component_id"]) for r in near), key=str) == sorted([(None, None)] * 3 + [(4, 4), (4, 4), (-3, -3)], key=str)


def test_token_blocks_round_trip():
    r = np.random.default_rng(1)
    for n in (0, 1, 127, 128, 129, 5000):
        for high in (1, 2, 50_000, 2**32):
            ids = r.integers(0, high, n, dtype=np.uint64).astype(np.uint32)
            ids[:: max(1, n // 9)] = high - 1
            counts, back = token_files.read_segment(token_files.segment([n], ids))
            assert (back == ids).all() and counts.tolist() == [n]
            start, data = token_files.pack(ids)
            if len(start) > 2:  # the index reaches any block alone
                assert (token_files.unpack(data, start[1:2], 128) == ids[128:256]).all()


def test_brown_lm(docs, small, empty):
    train = small.filter(langid.fold("doc_id", 7) != 2)
    model = brown_lm.fit(train, broadcast=300)  # so that most words are looked up
    got = {r["doc_id"]: r for r in rows(brown_lm.score(small, model))}
    count, tokens = {}, lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)})) + [None]
    for r in rows(train.select("text")):
        for w in tokens(r["text"]):
            count[w] = count.get(w, 0) + 1
    total, kinds = sum(count.values()), len(count)
    better = 0
    for r in rows(small.select("doc_id", "text")):
        g, ws = got[r["doc_id"]], tokens(r["text"])
        base = sum(np.log10((count.get(w, 0) + 1) / (total + kinds + 1)) for w in ws)
        assert (g["n_tokens"], g["n_known"], g["train_tokens"]) == (len(ws), sum(w in count for w in ws), total)
        assert g["base_score"] == pytest.approx(base, rel=1e-9) and np.isfinite(g["score"]) and g["score"] < 0
        better += g["score"] > g["base_score"]
    assert better > 0.9 * len(got)
    assert brown_lm.score(empty, model).count() == 0
    assert {r["doc_id"]: r["n_tokens"] for r in rows(brown_lm.score(docs, model))}[5] == 1
    none = rows(brown_lm.score(docs, brown_lm.fit(empty)))
    assert len(none) == len(ROWS) and all(np.isfinite(r["score"]) and r["base_score"] == 0 for r in none)


def class_likelihood(pairs, of):
    m = np.eye(of.max() + 1)[of]
    t = m.T @ pairs @ m
    return brown_lm.xlogx(t).sum() - brown_lm.xlogx(t.sum(0)).sum() - brown_lm.xlogx(t.sum(1)).sum()


def test_brown_score_by_hand(docs, small):
    """Scores from plain counts, given the classes; and each class placed, from the whole likelihood."""
    lists = [(r["text"] or "") for r in rows(small.select("text").limit(60))]
    spark = small.sparkSession
    train = spark.createDataFrame([(i, t) for i, t in enumerate(lists)], "doc_id bigint, text string").repartition(3)
    clustered, classes, listed = 40, 6, 400
    model = brown_lm.fit(train, clustered=clustered, classes=classes, broadcast=listed)
    words, n = [w for w, _ in model.known], dict(model.known)
    number = {w: i for i, w in enumerate(words)}
    count = {}
    for t in lists:
        for w in brown_lm.tokens(t):
            count[w] = count.get(w, 0) + 1
    order = sorted(count, key=lambda w: (-count[w], w))
    assert words == order[:listed] and all(n[w] == count[w] for w in words)

    def cls(w):
        return model.cls[-1] if w is None else model.cls[number[w]] if w in number else model.cls[len(words) + brown_lm.shape(w)]

    k = len(model.transition)
    table, size, types = np.zeros((k, k)), np.zeros(k), np.zeros(k)
    for t in lists:
        line = [None, *brown_lm.tokens(t), None]
        for a, b in zip(line, line[1:]):
            table[cls(a), cls(b)] += 1
    for w in count:
        size[cls(w)] += count[w]
        types[cls(w)] += 1
    got = {r["doc_id"]: r for r in rows(brown_lm.score(docs.select("doc_id", "text").distinct(), model))}
    for i, t, *_ in ROWS:
        line, want = [None, *brown_lm.tokens(t or ""), None], 0.0
        for a, b in zip(line, line[1:]):
            want += np.log10((table[cls(a), cls(b)] + 0.1) / (table[cls(a)].sum() + 0.1 * k))
            if b is not None:
                want += np.log10((count.get(b, 0) + 0.5) / (size[cls(b)] + 0.5 * (types[cls(b)] + 1)))
        assert got[i]["score"] == pytest.approx(want, rel=1e-9)
    # A word beyond the core: of all classes its own gives the table of core words, shapes and end the highest likelihood.
    units = {w: i for i, w in enumerate(words[:clustered])}

    def unit(w):
        return clustered + brown_lm.SHAPES if w is None else units[w] if w in units else clustered + brown_lm.shape(w)

    of = np.concatenate([model.cls[:clustered], model.cls[len(words) :]])
    base = np.zeros((k, k))
    for t in lists:
        line = [None, *brown_lm.tokens(t), None]
        for a, b in zip(line, line[1:]):
            base[of[unit(a)], of[unit(b)]] += 1
    for w in words[clustered::23]:
        best = []
        for g in range(classes):
            t = base.copy()
            for x in lists:
                line = [None, *brown_lm.tokens(x), None]
                for a, b in zip(line, line[1:]):
                    t[g, of[unit(b)]] += a == w
                    t[of[unit(a)], g] += b == w
            cells = brown_lm.xlogx(t).sum()
            out_of = sum(brown_lm.tokens(x).count(w) for x in lists)
            left, right = base.sum(axis=1), base.sum(axis=0)
            left[g] += out_of
            right[g] += out_of
            best.append(cells - brown_lm.xlogx(left).sum() - brown_lm.xlogx(right).sum())
        assert best[model.cls[number[w]]] == pytest.approx(max(best), rel=1e-12)


def test_frequent_words_break_ties(spark):
    counts = spark.createDataFrame([(f"w{i}", 0, 5) for i in range(30)] + [("x", 0, 9), (" ", -1, 99)], "word string, shape int, n bigint")
    assert [w for w, _ in brown_lm.frequent_words(counts, 4)] == [b"x", b"w0", b"w1", b"w10"]
    assert len(brown_lm.frequent_words(counts, 100)) == 31 and brown_lm.frequent_words(counts.filter("shape < 0"), 3) == []


def test_brown_model_is_a_distribution(small):
    model = brown_lm.fit(small)
    assert np.allclose((10**model.transition).sum(axis=1), 1)


def test_exchange_raises_the_likelihood_and_finds_classes():
    r = np.random.default_rng(5)
    kind = np.arange(40) % 2
    pairs = np.zeros((42, 42))
    for a in range(40):
        for b in range(40):
            pairs[a, b] = r.integers(20, 30) if kind[a] != kind[b] else r.integers(0, 2)
    order = r.permutation(40)
    pairs[:40, :40] = pairs[:40, :40][order][:, order]

    of = brown_lm.exchange(pairs, 40, 2)
    assert class_likelihood(pairs, of) >= class_likelihood(pairs, np.concatenate([np.arange(40) % 2, [2, 3]]))
    for u in range(40):  # no move raises it
        assert class_likelihood(pairs, np.where(np.arange(42) == u, 1 - of[u], of)) <= class_likelihood(pairs, of) + 1e-6
    assert len({(k, c) for k, c in zip(kind[order], of[:40])}) == 2
