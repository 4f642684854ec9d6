"""Lists and objects out of what a model wrote around them."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from contextlib import suppress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

FENCE = "```"
#: The widest span that could be a list, then one that could be an object.
SPANS = (re.compile(r"\[.*\]", re.S), re.compile(r"\{.*\}", re.S))


def unfenced(line: str) -> str:
    """A line without the marks of a code block at its ends."""
    if line.startswith(FENCE):
        line = line[len(FENCE) :].removeprefix("json")
    return line.removesuffix(FENCE)


def candidates(text: str) -> Iterator[str]:
    body = "\n".join(map(unfenced, text.strip().split("\n"))).strip()
    yield body
    yield from (found[0] for span in SPANS if (found := span.search(body)))


def tolerant(text: str | None):
    """The JSON value in a text: all of it but code fences, else its widest span in brackets, else in braces.

    Of an object that has lists the first list is the value; null if nothing parses.
    """
    for candidate in candidates(text or ""):
        with suppress(ValueError):
            value = json.loads(candidate)
            lists = [v for v in value.values() if isinstance(v, list)] if isinstance(value, dict) else []
            return lists[0] if lists else value
    return None


def parse_tolerant(c: Column) -> Column:
    """The same for a column, as canonical JSON text (null if nothing parses); Arrow batches."""

    @F.pandas_udf("string")
    def parse(s: pd.Series) -> pd.Series:
        found = map(tolerant, (t if isinstance(t, str) else None for t in s))
        return pd.Series([None if v is None else json.dumps(v, ensure_ascii=False, sort_keys=True) for v in found], dtype=object)

    return parse(c)
