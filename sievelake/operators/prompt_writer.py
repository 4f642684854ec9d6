"""The stage that has prompts written: jobs go to a model, its lists of items become prompt rows."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.json_tools import parse_tolerant
from ..sources import jobs as job_table
from ..sources.sinks import append
from .backends import Backend, called
from .joins import not_done
from .storage import stored

# How freely the writer draws for each task, and the fields that an item of each task must have.
TEMPERATURES = {"knowledge": 1.0, "comprehension": 0.9, "translation": 1.0, "summarisation": 0.9}
FIELDS = {"knowledge": ("question",), "comprehension": ("passage", "question"), "summarisation": ("passage",), "translation": ("text",)}
#: What a job asks for, in plain words; callers pass their own reviewed wordings.
ASK = {
    "knowledge": "questions that can be answered without any text at hand",
    "comprehension": "passages, each with one question that the passage answers",
    "summarisation": "passages worth summing up",
    "translation": "short texts to be translated",
}


def job_prompt(ask: dict[str, str] = ASK, fields: dict[str, tuple[str, ...]] = FIELDS) -> Column:
    """The text that asks for the items of a job (columns as ``writer_jobs`` makes them)."""
    what = shape = F.lit(None).cast("string")
    for task in fields:
        what = F.when(F.col("task") == task, ask[task]).otherwise(what)
        shape = F.when(F.col("task") == task, json.dumps(dict.fromkeys(fields[task], "..."))).otherwise(shape)
    about = F.concat(F.lit("Subject: "), "domain", F.lit(", "), "sub", F.lit(". Setting: "), F.lower("ctx"), F.lit("."))
    extra = F.concat_ws(
        " ",
        F.when(F.col("style").isNotNull(), F.concat(F.lit("Style: "), F.lower("style"), F.lit("."))),
        F.when(F.col("band").isNotNull(), F.concat(F.lit("Length class: "), F.col("band").cast("string"), F.lit("."))),
        F.when(F.col("direction").isNotNull(), F.concat(F.lit("Direction: "), "direction", F.lit("."))),
    )
    return F.concat_ws("\n", F.concat(F.lit("Write "), F.col("n").cast("string"), F.lit(" "), what, F.lit(".")), about, extra, F.concat(F.lit("Answer with a JSON list of objects like "), shape))


class StubWriter:
    """Offline: as many items as the job asks for, made from its text alone."""

    name = "stub:writer"

    def __call__(self, prompt: str, temperature: float, json_mode: bool = False) -> str:
        n, subject = int(prompt.split()[1]), prompt.split("Subject: ")[1].split(". ")[0]
        return json.dumps([{k: f"{k} {i} about {subject}" for k in ("question", "passage", "text")} for i in range(n)])


def answered(jobs: DataFrame, done: DataFrame, backend: Backend, temperatures: dict[str, float] = TEMPERATURES) -> DataFrame:
    """Jobs that aren't done, with ``items``: the list in the model's reply, as JSON texts. Without a usable list a job is left out."""
    todo = not_done(jobs, done).withColumn("ask", job_prompt())
    replies = None
    for task, temperature in temperatures.items():
        own = called(todo.filter(F.col("task") == task), backend, "ask", temperature, json_mode=True)
        replies = own if replies is None else replies.unionByName(own)
    parsed = stored(replies, "writer_replies").withColumn("parsed", parse_tolerant(F.col("reply")))
    return parsed.filter(F.startswith("parsed", F.lit("["))).withColumn("items", F.from_json("parsed", "array<string>")).drop("ask", "reply", "parsed")


def prompt_rows(answers: DataFrame, writer: str, fields: dict[str, tuple[str, ...]] = FIELDS, **rendering) -> DataFrame:
    """One row for each usable item: ids are the job's and the item's place; items that lack a field are left out."""
    shape = "struct<question string, passage string, text string>".replace(" string", ":string")
    items = answers.select("*", F.posexplode("items").alias("k", "item")).drop("items")
    items = items.withColumn("content", F.from_json("item", shape)).filter(F.startswith(F.ltrim(F.col("item")), F.lit("{")) & F.col("content").isNotNull())
    usable = job_table.usable_content(items, fields).withColumn("id", F.concat("id", F.lit("#"), F.col("k").cast("string")))
    rows = job_table.rendered(usable, **rendering)
    return rows.select("id", "task", "direction", "domain", F.col("sub").alias("subtopic"), F.col("ctx").alias("context"), "band", "style", "template_id", "content", "prompt", F.lit(writer).alias("prompt_writer"))


def write_prompts(jobs: DataFrame, done: DataFrame, backend: Backend, rows_path: str, done_path: str) -> None:
    """Ask for what isn't done, append the rows, and only then the jobs' ids: a crash in between repeats jobs, it loses none."""
    found = stored(answered(jobs, done, backend), "writer_answers")
    append(prompt_rows(found, backend.name), rows_path)
    append(found.select("id"), done_path, "text")
