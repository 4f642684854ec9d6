"""Calls to outside models as a batch operator: any callable that maps prompts to replies, run inside partitions."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .joins import attach_replies, not_done
from .sampling import batches

# Attempts a call, seconds waited at first and at most, and failed calls in a row that end a partition.
ATTEMPTS, FIRST_WAIT, LONGEST_WAIT, FAILURES = 6, 3.0, 90.0, 5
PROMPT_BATCH, ANSWER_BATCH = 6, 8


class Backend(Protocol):
    """``name`` says which model it is; a call returns the reply, or None if the model gave none."""

    name: str

    def __call__(self, prompt: str, temperature: float, json_mode: bool = False) -> str | None: ...


class QuotaExhausted(RuntimeError):
    """Raised by a backend to end the run at once; what is done is kept."""


class JsonModeRejected(RuntimeError):
    """Raised by a backend whose model knows no JSON mode: the call, and all later ones of the task, go without it."""


class StubBackend:
    """Offline: replies that depend on the prompt alone."""

    name = "stub:echo"

    def __call__(self, prompt: str, temperature: float, json_mode: bool = False) -> str | None:
        h = hashlib.md5(prompt.encode()).hexdigest()
        if not json_mode:
            return f"answer {h[:8]}"
        n = prompt.count("### ")
        return json.dumps([{"i": i, "natural": 3 + int(h[i % 32], 16) % 3, "answerable": 5, "fluency": 4, "accuracy": 5, "task": 5} for i in range(n)])


def called(df: DataFrame, backend: Backend, prompt: str, temperature: float, json_mode: bool = False, name: str = "reply", sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """``df`` with the backend's reply to each prompt; parallel by partition.

    A call that fails is tried again after growing waits; an empty reply is not. JSON mode is switched off once the model
    rejects it; that call counts as an attempt without a wait. When FAILURES calls in a row have failed,
    the partition's other rows get no reply: they stay undone and a later run takes them up.
    """
    schema = StructType([*df.schema.fields, StructField(name, StringType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        streak, as_json = 0, json_mode
        for frame in frames:
            replies: list[str | None] = []
            for p in frame[prompt]:
                reply = None
                if streak < FAILURES:
                    for attempt in range(ATTEMPTS):
                        try:
                            reply = backend(p, temperature, as_json) or None
                            streak = 0
                            break
                        except QuotaExhausted:
                            streak = FAILURES
                            break
                        except JsonModeRejected:
                            as_json = False
                        except Exception:  # noqa: BLE001  whatever the client raises
                            sleep(min(LONGEST_WAIT, FIRST_WAIT * 2**attempt))
                    else:
                        streak += 1
                replies.append(reply)
            yield frame.assign(**{name: replies})

    return df.mapInPandas(run, schema)


def answers(prompts: DataFrame, done: DataFrame, backend: Backend, temperature: float = 0.3, limit_per_group: int | None = None, group: str = "task", order: str = "seq") -> DataFrame:
    """New answers (id, response, teacher) to prompts without one; rows without a reply are left for the next run."""
    todo = not_done(prompts, done)
    if limit_per_group is not None:
        from .sampling import first_k

        todo = first_k(todo, (group,), limit_per_group, order)
    out = called(todo, backend, "prompt", temperature)
    return out.filter("reply is not null").withColumn("response", F.trim("reply")).withColumn("teacher", F.lit(backend.name)).drop("reply")


def judged(rows: DataFrame, done: DataFrame, backend: Backend, body: str, fields: tuple[str, ...], size: int, order: str = "seq") -> DataFrame:
    """Scores of rows not judged yet: batches of ``size`` numbered texts a call, replies joined back by their place.

    Rows that a reply leaves out stay unscored (null) and can be judged again.
    """
    from ..functions.json_tools import parse_tolerant

    numbered = batches(not_done(rows, done), size, (), order)
    sheet = numbered.groupBy("batch_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", body))), lambda x: F.concat(F.lit("### "), x["i"].cast("string"), F.lit("\n"), x[body])), "\n\n").alias("sheet"))
    replies = called(sheet, backend, "sheet", 0.0, json_mode=True).select("batch_id", parse_tolerant(F.col("reply")).alias("reply"))
    return attach_replies(numbered, replies, fields).withColumn("judge", F.lit(backend.name))


def judges_itself(judge: str, writer: str) -> bool:
    """Whether two backends (kind:model) are one model."""
    return judge.split(":", 1)[-1] == writer.split(":", 1)[-1]


def token_counts(df: DataFrame, count: Callable[[str], int] | None, text: str = "text", name: str = "tokens") -> DataFrame:
    """Token counts by a tokenizer's counting function (Arrow batches), or words times three without one."""
    from ..functions.text import token_estimate

    if count is None:
        return df.withColumn(name, token_estimate(F.col(text)))

    @F.pandas_udf("long")
    def counted(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else count(t)).astype("Int64")

    return df.withColumn(name, counted(text))


def answer_labels(prompt_ids: str, full_ids: str):
    """Labels of a training pair: the common start of both id arrays is masked (-100), so that only the answer is learned."""
    p, f = F.col(prompt_ids), F.col(full_ids)
    pairs = F.zip_with(F.slice(p, 1, F.least(F.size(p), F.size(f))), F.slice(f, 1, F.least(F.size(p), F.size(f))), lambda a, b: a == b)
    common = F.coalesce(F.array_position(pairs, False) - 1, F.lit(-1))
    common = F.when(common < 0, F.size(pairs)).otherwise(common)
    return F.transform(f, lambda x, i: F.when(i < common, F.lit(-100)).otherwise(x))


def short_enough(df: DataFrame, ids: str, most: int = 1024) -> DataFrame:
    """Pairs of at most ``most`` tokens: longer ones are left out, never cut."""
    return df.filter(F.size(ids) <= most)
