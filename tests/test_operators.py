"""Relational operators against plain Python, golden figures, sources and sinks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievelake.functions import text
from sievelake.operators import backends, cascade, contamination, joins, metrics, near_dup, prompt_writer, ratings, reports, sampling
from sievelake.plans import catalogue
from sievelake.sources import jobs, readers, sinks
from sievelake.streaming import incremental
from tests.test_functions import grams, norm

POLICY = cascade.PromptPolicy(share=lambda c: F.lit(1.0), scripts_matter=False)


def likeness(a, b):
    return len(a & b) / len(a | b)


def test_greedy_keep_equals_the_walk(spark):
    r = random.Random(4)
    n = 150
    links = {tuple(sorted(r.sample(range(n), 2))) for _ in range(200)}
    may = [r.random() < 0.9 for _ in range(n)]
    groups = {i: r.randrange(60) for i in range(n)}
    kept = []
    for i in range(n):
        if may[i] and not any(groups[k] == groups[i] or tuple(sorted((groups[k], groups[i]))) in links for k in kept):
            kept.append(i)
    nodes = spark.createDataFrame(list(enumerate(may)), "node int, may_keep boolean")
    members = spark.createDataFrame(list(groups.items()), "node int, key int")
    got = near_dup.greedy_keep(nodes, members, spark.createDataFrame(sorted(links), "a int, b int"))
    assert sorted(r["node"] for r in got.filter("kept").collect()) == kept


@pytest.mark.parametrize("block", [2048, 7])
def test_similar_pairs_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(near_dup, "BLOCK", block)
    docs = [(r["doc_id"], norm(r["text"])) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    sets = {i: grams(t) for i, t in docs}
    want = {(a, b) for a in sets for b in sets if a < b and likeness(sets[a], sets[b]) > 0.8}
    df = spark.createDataFrame([*docs, (10**6, None)], "id bigint, text string")
    got = near_dup.similar_pairs(df).collect()
    assert {(r["a"], r["b"]) for r in got} == want and len(got) == len(want)
    assert all(r["jaccard"] == likeness(sets[r["a"]], sets[r["b"]]) for r in got)


def test_near_hits_equal_brute_force(spark, monkeypatch):
    """Prompt and content apart, texts in any Unicode form and beyond the basic plane, nulls; also with many blocks."""
    import unicodedata

    words = ["café", "naïve", "Straße", "the", "river", "ሰላም", "𝔘𝔫𝔦", "bank", "résumé", "no"]
    draw = random.Random(3)
    made = lambda n: " ".join(draw.choice(words) for _ in range(n))
    ev = [(i, f"E{i}", made(draw.randrange(1, 30))) for i in range(40)] + [(40, "E40", ""), (41, "E41", "ab")]
    docs = [(i, unicodedata.normalize("NFD", t) if i % 2 else t, c) for i, (t, c) in enumerate([(made(draw.randrange(1, 60)), made(draw.randrange(1, 20))) for _ in range(60)])]
    docs += [(100, None, None), (101, None, ev[3][2]), (102, "ab", None), (103, "", "")]
    evals = spark.createDataFrame(ev, "eval_index int, eval_id string, prompt string")
    df = spark.createDataFrame(docs, "id bigint, prompt string, content string")
    want = {}
    for i, p, c in docs:
        for k, name, e in ev:
            g = grams(norm(e))
            x, y = (None if t is None else grams(norm(t)) for t in (p, c))
            j, ce, cc = (0.0, 0.0, 0.0)
            if x:
                j, ce = likeness(x, g), len(x & g) / len(g)
            if y:
                cc = len(y & g) / len(y)
            if j > 0.4 or ce > 0.6 or cc > 0.6:
                want[i] = (k, name, j, ce, cc)
                break
    for chars in (contamination.BLOCK_CHARS, 300):
        monkeypatch.setattr(contamination, "BLOCK_CHARS", chars)
        got = {r["id"]: (r["eval_index"], r["eval_id"], r["jaccard"], r["eval_in_prompt"], r["content_in_eval"]) for r in contamination.near_hits(df, evals).collect()}
        assert got == want and len(want) > 20


def test_writer_stage(spark, tmp_path):
    todo = jobs.writer_jobs(spark).filter("i < 4")
    rows_path, done_path = f"{tmp_path}/rows", f"{tmp_path}/done"
    prompt_writer.write_prompts(todo, todo.filter("i = 0").select("id"), prompt_writer.StubWriter(), rows_path, done_path)
    rows = spark.read.json(rows_path).collect()
    done = {r["id"] for r in readers.read_ids(spark, done_path).collect()}
    assert done == {f"{t}|{i}" for t in jobs.TARGETS for i in (1, 2, 3)} and len(rows) == 3 * sum(jobs.ITEMS_PER_CALL.values())
    assert {r["id"].split("#")[0] for r in rows} == done and all(r["prompt"] and r["template_id"] and r["prompt_writer"] == "stub:writer" for r in rows)

    class Odd(prompt_writer.StubWriter):
        def __call__(self, prompt, temperature, json_mode=False):
            return {"10": '```json\n[{"question": " a  b "}, 3, {"other": 1}, "x"]\n```', "3": "no list", "8": '{"items": [{"text": "t"}]}'}.get(prompt.split()[1])

    found = prompt_writer.answered(todo, todo.filter("i > 0").select("id"), Odd())
    assert sorted(r["id"] for r in found.collect()) == ["knowledge|0", "translation|0"]
    got = {r["id"]: r["content"] for r in prompt_writer.prompt_rows(found, "w").collect()}
    assert set(got) == {"knowledge|0#0", "translation|0#0"} and got["knowledge|0#0"]["question"] == "a b"


def test_json_mode_is_switched_off(spark):
    class Plain:
        name = "plain"

        def __call__(self, prompt, temperature, json_mode=False):
            if json_mode:
                raise backends.JsonModeRejected
            return prompt.upper()

    df = spark.createDataFrame([("a",), ("b",)], "p string").coalesce(1)
    assert [r["reply"] for r in backends.called(df, Plain(), "p", 0.0, json_mode=True, sleep=lambda s: 1 / 0).collect()] == ["A", "B"]


def test_replace_leaves_old_or_new(spark, tmp_path):
    import os

    path = f"{tmp_path}/d"
    sinks.replace(spark.range(3), path, "parquet")
    os.rename(path, f"{path}.before")  # a crash between the two moves
    sinks.recover(spark, path)
    assert spark.read.parquet(path).count() == 3
    os.mkdir(f"{path}.before")  # a crash before the last deletion
    sinks.replace(spark.range(5), path, "parquet")
    assert spark.read.parquet(path).count() == 5 and not os.path.exists(f"{path}.before")


def test_first_existing(spark, tmp_path):
    for name in ("b_eval.csv", "a_eval_predictions.csv", "c.txt"):
        (tmp_path / name).write_text("x")
    assert readers.first_existing(spark, [f"{tmp_path}/none*", f"{tmp_path}/*eval*.csv"], ("predictions",)).endswith("/b_eval.csv")
    assert readers.first_existing(spark, [f"{tmp_path}/c.txt"], ("c",)) is None


def test_bundle_and_rating_file(spark, tmp_path):
    import io
    import zipfile

    sinks.put_text(spark, f"{tmp_path}/f/a.txt", "12345")
    sinks.put_text(spark, f"{tmp_path}/f/g/b.txt", "x")
    sinks.bundle(spark, f"{tmp_path}/f", f"{tmp_path}/out.zip")
    with zipfile.ZipFile(io.BytesIO(open(f"{tmp_path}/out.zip", "rb").read())) as z:
        assert {n: z.read(n) for n in z.namelist()} == {"a.txt": b"12345", "g/b.txt": b"x"}
    given = spark.createDataFrame([("E2", 1, 2, 3, 4), ("E1", 5, 5, 5, 5), ("E3", 1, None, 2, 3)], "eval_id string, fluency_A int, correct_A int, fluency_B int, correct_B int")
    ratings.save(given, f"{tmp_path}/ratings")
    assert [r["eval_id"] for r in readers.read_csv(spark, f"{tmp_path}/ratings").collect()] == ["E1", "E2"]


def test_sizes_and_lengths(spark, tmp_path):
    sinks.put_text(spark, f"{tmp_path}/f/a.txt", "12345")
    sinks.put_text(spark, f"{tmp_path}/f/g/b.bin", "123")
    assert reports.folder_bytes(spark, f"{tmp_path}/f") == 8 and reports.folder_bytes(spark, f"{tmp_path}/f", (".bin",)) == 3
    df = spark.createDataFrame([("k", "a b", "c"), ("k", "a", None), ("k", "a b c", None), ("l", "x", None)], "task string, prompt string, content string")
    got = {r["task"]: tuple(r)[1:] for r in reports.length_report(df, "task", {"p": F.col("prompt"), "c": F.col("content")}).select("task", "n", "p_min", "p_median", "p_max", "c_median").collect()}
    assert got == {"k": (3, 1, 2, 3, 1), "l": (1, 1, 1, 1, None)}


BASE = "the quick brown fox jumps over the lazy dog near the river bank every morning"


def prompt_rows():
    texts = [
        BASE, BASE + " again", BASE, "a wholly different text about coffee and its long history in the hills", "Question: what", "short one here",
        "the evaluation text stands here word for word", "The Evaluation text stands here, word for word!", "eval near copy text of some length it has", BASE + " again",
        "low scored prompt that is otherwise quite fine", "low scored prompt that is otherwise quite fine", "unscored prompt that is also entirely fine",
    ]
    return [(i, f"p{i}", "knowledge", None, None, t, t, None, None, [t]) for i, t in enumerate(texts)]


SCHEMA = "seq int, id string, task string, direction string, band int, prompt string, content string, passage string, source_text string, parts array<string>"


def test_prompt_cascade_equals_the_walk(spark):
    rows = prompt_rows()
    ev = [(0, "E01", "the evaluation text stands here word for word"), (1, "E02", "eval near copy text of some length it had")]
    scores = [("p10", 0, "2", "5"), ("p11", 0, "5", "5"), ("p11", 1, "3", "5")]
    df = spark.createDataFrame(rows, SCHEMA)
    out = cascade.prompt_cascade(df, spark.createDataFrame(ev, "eval_index int, eval_id string, prompt string"), spark.createDataFrame(scores, "id string, seq int, natural string, answerable string"), POLICY)
    got = {r["id"]: r["reason"] for r in out.collect()}
    last = {"p10": 2, "p11": 3}
    want, kept = {}, []
    for r in rows:
        t = norm(r[5])
        if r[5].startswith("Question:"):
            want[r[1]] = "label_in_content"
        elif any(t.replace(" ", "") == norm(e[2]).replace(" ", "") for e in ev):
            want[r[1]] = "exact_duplicate_eval"
        elif any(t == k for k in kept):
            want[r[1]] = "exact_duplicate_train"
        elif any(likeness(grams(t), grams(norm(e[2]))) > 0.4 or len(grams(t) & grams(norm(e[2]))) / len(grams(norm(e[2]))) > 0.6 or len(grams(t) & grams(norm(e[2]))) / len(grams(t)) > 0.6 for e in ev):
            want[r[1]] = "near_dup_eval"
        elif last.get(r[1], 5) < 4:
            want[r[1]] = "low_prompt_quality"
        elif any(likeness(grams(t), grams(k)) > 0.8 for k in kept):
            want[r[1]] = "near_dup_train"
        else:
            want[r[1]] = None
            kept.append(t)
    assert got == want
    assert {"near_dup_train", "exact_duplicate_train", "near_dup_eval", "low_prompt_quality"} <= set(want.values())
    assert want["p9"] == "near_dup_train"  # an exact copy of a row that was itself dropped as a near copy


def test_length_bounds_are_kept(spark):
    rows = []
    for i, n in enumerate((37, 38, 39, 144, 145, 35)):  # band 0: 55 to 90 words, so 38.5 and 144
        t = " ".join(f"w{k}" for k in range(n))
        rows.append((i, f"p{i}", "comprehension", None, 0, t, t, t, None, [t]))
    df = spark.createDataFrame(rows, SCHEMA)
    got = [r["r"] for r in df.orderBy("seq").select(cascade.first_reason(cascade.prompt_rules(POLICY)).alias("r")).collect()]
    assert [x == "passage_length" for x in got] == [True, True, False, False, True, True]


def test_answer_cascade(spark):
    ok = ("4", "5", "5")
    rows = [
        ("a", "ሰላም ነው ጥሩ መልስ", ok), ("b", "ሰላም ነው", ("3", "5", "5")), ("c", "  ", ok), ("d", "**ሰላም**", ok), ("e", "እኔ አልችልም", ok), ("f", "english words", ok), ("g", "ሰላም привет ነው ጥሩ ሰላም ነው ጥሩ ሰላም ነው ጥሩ ሰላም ነው ጥሩ ሰላም ነው", ok),
        ("h", "የ አዲስ በ ቤት", ok), ("i", "ሰላም " * 67, ok), ("j", "ሰላም ነው", None), ("k", "ሰላምነውልጅ", ok), ("z", "ሰላም", ok),
    ] + [(f"v{i}", "ሰላምነው ልጅ", ok) for i in range(6)]
    df = spark.createDataFrame([(i, "knowledge", None, "ጥያቄ", r, dict(zip(("fluency", "accuracy", "task"), s)) if s else None) for i, r, s in rows], "id string, task string, direction string, prompt string, response string, scores struct<fluency:string,accuracy:string,task:string>")
    got = {r["id"]: r["reason"] for r in cascade.answer_cascade(df, df.filter("id <> 'z'")).collect()}
    want = {"a": None, "b": "low_or_missing_score", "c": "empty", "d": "markdown_or_preamble", "e": "refusal", "f": "script_mismatch", "g": "foreign_or_mixed_script", "h": "detached_particles", "i": "answer_too_long", "j": "low_or_missing_score", "k": "glued_words", "z": "prompt_no_longer_clean"}
    assert {k: got[k] for k in want} == want


def test_exact_hits_know_the_context(spark):
    ev = spark.createDataFrame([(0, "E1", "do it\n\nContext:\nthe body"), (1, "E2", "other"), (2, "E3", "OTHER")], "eval_index int, eval_id string, prompt string")
    df = spark.createDataFrame([("x", "q", "The body!"), ("y", "other", "z"), ("w", "n", "m")], "id string, prompt string, content string")
    assert {r["id"]: r["eval_id"] for r in contamination.exact_hits(df, ev).collect()} == {"x": "E1", "y": "E3"}
    with pytest.raises(ValueError):
        contamination.checked_eval(ev, 60)


def test_round_robin_equals_pools(spark):
    import hashlib

    ids = list(range(90))
    rows = [(i, "t", "abc"[i % 7 % 3]) for i in ids]
    h = {i: hashlib.md5(f"42-{i}".encode()).hexdigest() for i in ids}
    pools: dict = {}
    for i in sorted(ids, key=h.get):
        pools.setdefault("abc"[i % 7 % 3], []).append(i)
    order, queues = [], list(pools.values())
    while any(queues):
        for q in queues:
            if q:
                order.append(q.pop(0))
    got = sampling.round_robin(spark.createDataFrame(rows, "id int, task string, band string"), ("task",), "band", F.lit(40))
    assert sorted(r["id"] for r in got.collect()) == sorted(order[:40])


def test_joins(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    s = spark.createDataFrame([(2, "new")], "k int, v string")
    assert {r["k"]: r["v"] for r in joins.updated(t, s, "k", "v").collect()} == {1: "a", 2: "new"}
    b = spark.createDataFrame([(0, i) for i in range(3)], "batch_id bigint, i int")
    r = spark.createDataFrame([(0, '[{"i":0,"x":1},{"i":2,"x":2},{"i":2,"x":3},{"x":9}]')], "batch_id bigint, reply string")
    assert {x["i"]: x["x"] for x in joins.attach_replies(b, r, ("x",)).collect()} == {0: 1.0, 1: None, 2: 3.0}
    with pytest.raises(ValueError):
        joins.filled_predictions(t, t, t)


# Golden figures: task, n, wins, ties, losses and means of a finished blind rating, rebuilt from its totals.
def test_rating_summary(spark):
    rows = [(f"E{i}", "t1" if i < 6 else "t2", 3, 4, w, 3) for i, w in enumerate([4, 4, 4, 3, 3, 2, 5, 3, 1, 1])]
    key = spark.createDataFrame([(e, "distilled" if i % 2 else "base", "base" if i % 2 else "distilled") for i, (e, *_) in enumerate(rows)], "eval_id string, A_is string, B_is string")
    given = [(e, fd, cd, fb, cb) if i % 2 else (e, fb, cb, fd, cd) for i, (e, _, fb, fd, cd, cb) in enumerate(rows)]
    r = spark.createDataFrame(given, "eval_id string, fluency_A int, correct_A int, fluency_B int, correct_B int")
    tasks = spark.createDataFrame([(e, t) for e, t, *_ in rows], "eval_id string, task string")
    got = ratings.summary(ratings.by_model(ratings.complete(r), key, tasks)).collect()
    assert [(x["task"], x["n"], x["wins_distilled"], x["ties"], x["wins_base"]) for x in got] == [("t1", 6, 3, 2, 1), ("t2", 4, 1, 1, 2), ("OVERALL", 10, 4, 3, 3)]
    assert got[-1]["fluency_base"] == 3 and got[-1]["fluency_distilled"] == 4 and got[-1]["correct_base"] == 3 and got[-1]["correct_distilled"] == 3
    assert ratings.still_open(tasks, r.filter("eval_id <> 'E3'")).count() == 1


def test_chrf(spark):
    df = spark.createDataFrame([(0, "k", "the cat sat", "the cat sat"), (1, "l", "abc", "xyz"), (2, "m", "ab", "abc")], "id int, task string, text string, teacher string")
    got = {r["task"]: r["chrf"] for r in metrics.chrf(df, ("task",)).collect()}
    f = lambda p, r: 5 * p * r / (4 * p + r)
    assert got["k"] == pytest.approx(100) and got["l"] == 0
    assert got["m"] == pytest.approx(100 * (f(1, 2 / 3) + f(1, 1 / 2) + 0) / 3)  # characters of order 1 and 2, words of order 1


def test_reports(spark):
    import hashlib

    ev = spark.createDataFrame([(1, "b"), (0, "a")], "eval_index int, prompt string")
    assert reports.digest(ev, "eval_index", "prompt").first() == (2, hashlib.sha256(b"a\0b").hexdigest())
    df = spark.createDataFrame([(0, "x", None), (1, "y", "r1"), (2, "z", "r2"), (3, "w", "r2")], "seq int, id string, reason string")
    assert [tuple(r) for r in reports.reasons(df).collect()] == [("r2", 2, 2), ("r1", 1, 1)]
    meta = reports.filter_meta(df, df.filter("reason is null"), ev, 42, {"j": 0.4})
    assert '"n_raw":4' in meta.first()[0] and not reports.stale(meta, ev) and reports.stale(meta, ev.limit(1))
    md = reports.examples_markdown("Removed", reports.example_rows(df.filter("reason is not null"), "reason", ["id"]), "reason", "id")
    assert "**r2**: 2." in md
    assert reports.run_record(spark, "filter", 42, kept=3).count() == 1
    assert "| a |" in reports.efficiency_markdown(spark.createDataFrame([("a", 1.234)], "label string, x double"))


def test_sources_and_sinks(spark, tmp_path):
    p = str(tmp_path)
    rows = spark.createDataFrame([("a", 'x "q"\nline sep', None), ("b", "", "t")], "id string, text string, note string")
    sinks.replace(rows, f"{p}/j")
    sinks.replace(rows, f"{p}/j")
    sinks.append(rows.limit(1), f"{p}/j")
    back = readers.read_jsonl(spark, f"{p}/j", rows.schema)
    assert back.count() == 3 and {r["text"] for r in back.collect()} == {'x "q"\nline sep', ""}
    assert readers.read_jsonl(spark, f"{p}/none", rows.schema).count() == 0
    sinks.write_csv(rows, f"{p}/c")
    assert {r["text"] for r in readers.read_csv(spark, f"{p}/c").collect()} == {'x "q"\nline sep', ""}
    sinks.put_text(spark, f"{p}/e.csv", '﻿Eval_ID , Prompt\nE7," a ""b"" "\n, \n,c\n')
    assert [tuple(r) for r in readers.read_eval_csv(spark, f"{p}/e.csv").select("eval_id", "prompt").orderBy("eval_index").collect()] == [("E7", 'a "b"'), ("E03", "c")]
    sinks.put_text(spark, f"{p}/e.txt", "one\ntwo\n-----\nthree\n---  \n\n")
    assert [tuple(r) for r in readers.read_eval_text(spark, f"{p}/e.txt").select("eval_id", "prompt").collect()] == [("E01", "one\ntwo"), ("E02", "three")]
    sinks.put_text(spark, f"{p}/f.txt", "one\n\ntwo\n")
    assert [r["prompt"] for r in readers.read_eval_text(spark, f"{p}/f.txt").collect()] == ["one", "two"]
    assert readers.first_existing(spark, [f"{p}/none", f"{p}/e.txt"]).endswith("e.txt")
    with pytest.raises(ValueError):
        readers.require_rows(rows, 60)
    with pytest.raises(ValueError):
        readers.require_columns(rows, {"prompt"})
    assert readers.same_ids_in_order(rows, rows, "id")
    full = rows.selectExpr("id", "'knowledge' task", "cast(null as string) direction", "'d' domain", "'s' subtopic", "'t' template_id", "text prompt", "text response", "1 prompt_tokens", "2 answer_tokens", "named_struct('fluency', 5) scores", "'m' teacher", "'w' prompt_writer")
    assert sinks.full_table(full).first()["judge_scores"] == '{"fluency":5}' and sinks.full_table(full).columns == list(sinks.FULL)
    assert sinks.submission(full).first()["task"] == "closed_book_knowledge"
    assert sinks.review_sheet(full, ["id"], ["notes"]).columns == ["id", "notes"]


def test_jobs(spark):
    made = jobs.writer_jobs(spark)
    assert {r["task"]: r["count"] for r in made.groupBy("task").count().collect()} == {"knowledge": 60, "comprehension": 834, "translation": 75, "summarisation": 834}
    assert made.filter("domain = 'news' and band is not null and style <> 'NEWS'").count() == 0


def test_backends_retry_and_give_up(spark):
    class Flaky:
        name = "flaky:m"

        def __init__(self):
            self.calls = 0

        def __call__(self, prompt, temperature, json_mode=False):
            self.calls += 1
            if prompt == "bad" or self.calls % 2:
                raise RuntimeError("busy")
            return None if prompt == "blocked" else prompt.upper()

    df = spark.createDataFrame([("a",), ("blocked",), ("bad",), ("b",)], "p string").coalesce(1)
    got = {r["p"]: r["reply"] for r in backends.called(df, Flaky(), "p", 0.0, sleep=lambda s: None).collect()}
    assert got == {"a": "A", "blocked": None, "bad": None, "b": "B"}
    assert backends.judges_itself("x:m", "y:m") and not backends.judges_itself("x:m", "x:n")


def test_labels_mask_the_prompt(spark):
    df = spark.createDataFrame([([1, 2, 3], [1, 2, 3, 4, 5]), ([1, 2, 3], [1, 2, 9, 4]), ([], [7])], "p array<int>, f array<int>")
    assert [r[0] for r in df.select(backends.answer_labels("p", "f")).collect()] == [[-100, -100, -100, 4, 5], [-100, -100, 9, 4], [7]]
    assert backends.short_enough(df, "f", 4).count() == 2


def test_streaming(spark, tmp_path):
    p = str(tmp_path)
    rows = spark.createDataFrame([("a", "same text"), ("b", "Same, text"), ("c", ""), ("d", "more")], "id string, text string")
    rows.coalesce(1).write.json(f"{p}/in")
    stream = incremental.without_copies(incremental.new_rows(spark, f"{p}/in", "id string, text string"))
    q = incremental.append_filtered(stream, [("empty", text.strip(F.col("text")) == "")], f"{p}/kept", f"{p}/dropped", f"{p}/cp")
    q.awaitTermination(120)
    assert spark.read.parquet(f"{p}/kept").count() == 2 and spark.read.parquet(f"{p}/dropped").count() == 1
    incremental.append_filtered(stream, [("empty", F.lit(False))], f"{p}/kept", f"{p}/dropped", f"{p}/cp").awaitTermination(120)
    assert spark.read.parquet(f"{p}/kept").count() == 2


def test_csv_keeps_every_text(spark, tmp_path):
    """White space and control characters at the ends, line ends, quotes, backslashes, NUL, empty and null."""
    odd = [" a", "a ", "\ta\t", "\n", "\r", "a\r\nb", "a\rb", "\na", "a\n", " ", " a", "\0", "\0a", "a\0", "\x1fa", '"', '""', 'a"', '"a,b\nc', "\\", 'a\\"b', "a,b", "#a", "", None]
    df = spark.createDataFrame(list(enumerate(odd)), "n int, t string").select(F.col("n").cast("string").alias("n"), "t", F.col("t").alias("again"))
    sinks.write_csv(df, f"{tmp_path}/odd")
    got = {int(r["n"]): (r["t"], r["again"]) for r in readers.read_csv(spark, f"{tmp_path}/odd").collect()}
    assert got == {i: (t or "", t or "") for i, t in enumerate(odd)}


def test_bitmaps_tell_long_texts_apart():
    """Sets of many thousands of grams, far more than the least bitmap has bits; like ones are found in and across blocks."""
    draw = np.random.default_rng(7)
    sets = [np.unique(draw.integers(0, 1 << 40, size)).astype(np.uint64) for size in (3000, 6000, 6500, 7000, 9000, 9200)]
    sets.append(np.sort(np.append(sets[3][300:], np.arange(300, dtype=np.uint64) * np.uint64(977))))  # like the fourth
    sets.sort(key=len)
    n = np.array([s.size for s in sets])
    held = [np.frombuffer(near_dup.bitmap(s), dtype=np.uint64) for s in sets]
    bits = np.stack([near_dup.narrowed(b[None], min(h.size for h in held))[0] for b in held])
    share = lambda a, b: np.intersect1d(a, b).size / np.union1d(a, b).size
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if share(sets[i], sets[j]) > 0.8}
    got = {(int(i), int(j)) for x, y in near_dup.likely_pairs(n, bits, n, bits, True, 0.8) for i, j in zip(x, y)}
    assert len(want) == 1 and want == got
    assert sum(x.size for x, _ in near_dup.likely_pairs(n[:4], bits[:4], n[4:], bits[4:], False, 0.8)) == sum(i < 4 <= j for i, j in want)


def test_ngram_matches_equal_counters():
    from collections import Counter

    draw = random.Random(9)
    sides = [["".join(draw.choice("abc\U0001f600") for _ in range(draw.randrange(12))) for _ in range(30)] for _ in "hr"]
    units = [np.frombuffer("".join(s).encode("utf-32-le"), dtype="<u4") for s in sides]
    sizes = [np.array([len(t) for t in s]) for s in sides]
    for n, found in enumerate(metrics.ngram_matches(units, sizes, 6), 1):
        for i, (a, b) in enumerate(zip(*sides)):
            x, y = (Counter(t[k : k + n] for k in range(len(t) - n + 1)) for t in (a, b))
            assert [int(f[i]) for f in found] == [x.total(), y.total(), (x & y).total()]


def test_no_plan_has_a_row_an_ngram_or_reads_texts_twice(spark):
    """chrF++ counts n-grams where rows are read; glued words come from one scan of the texts; grams are counted without making strings."""
    sf = "/root/testdata/sf0.001"
    plan = lambda name: catalogue.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan("chrf_corpus") and "Join" not in plan("chrf_corpus")
    assert "documents" not in plan("glued_words") and "split(" not in plan("glued_words")
    assert "MapInArrow" in plan("char_ngrams_size") and "regexp_extract_all" not in plan("char_ngrams_size")
    assert plan("prompt_rules_local").count(r"regexp_replace(content") <= 1
