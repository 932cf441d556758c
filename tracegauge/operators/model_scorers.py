"""Scorers that call a model: loaded once per worker, fed in batches of bounded size.

``model_scorer`` turns two plain functions into a scorer for ``operators.scoring``. Spark hands each task its rows as
Arrow batches; these are cut by characters, so a batch of long texts does not outgrow the model. A batch that
fails is tried again, then cut in halves, until the rows that cannot be scored stand alone; those get NULL.
"""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Module that holds the models of a Python worker; workers outlive their tasks.
SHELF = "_tracegauge_models"


def loaded(name: str, load: Callable[[], Any]) -> Any:
    """The model of this worker, loaded at its first use."""
    shelf = sys.modules.setdefault(SHELF, types.ModuleType(SHELF)).__dict__
    if name not in shelf:
        shelf[name] = load()
    return shelf[name]


def cut(statements: list, sources: list, rows: int, chars: int) -> Iterator[tuple[list, list]]:
    """Consecutive parts of at most ``rows`` rows and ``chars`` characters; a longer row is a part of its own."""
    start = size = 0
    for i, (a, b) in enumerate(zip(statements, sources)):
        own = len(a or "") + len(b or "")
        if i > start and (i - start >= rows or size + own > chars):
            yield statements[start:i], sources[start:i]
            start, size = i, 0
        size += own
    if statements:
        yield statements[start:], sources[start:]


def scored(score: Callable, model: Any, statements: list, sources: list, tries: int) -> list:
    """One score or None per row. What fails ``tries`` times is scored in halves."""
    for _ in range(max(1, tries)):
        try:
            found = list(score(model, statements, sources))
            if len(found) != len(statements):
                raise ValueError(f"{len(found)} scores for {len(statements)} rows")
            return [None if x is None or x != x else float(x) for x in found]
        except Exception as e:  # noqa: BLE001 - whatever a model raises
            failure = e
    if len(statements) == 1:
        sys.stderr.write(f"no score for one row: {failure}\n")
        return [None]
    half = len(statements) // 2
    return [x for part in (slice(None, half), slice(half, None)) for x in scored(score, model, statements[part], sources[part], tries)]


def model_scorer(
    load: Callable[[], Any],
    score: Callable[[Any, list[str], list[str]], list[float | None]],
    batch_rows: int = 64,
    batch_chars: int = 1 << 20,
    tries: int = 2,
) -> Callable[[Column, Column], Column]:
    """A scorer from ``load()``, which gives the model, and ``score(model, statements, sources)``, which gives a number per row."""
    name = uuid.uuid4().hex

    @F.arrow_udf("double")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        model = None
        for a, b in batches:
            model = loaded(name, load) if model is None else model
            found: list = []
            for statements, sources in cut(a.to_pylist(), b.to_pylist(), batch_rows, batch_chars):
                found += scored(score, model, statements, sources, tries)
            yield pa.array(found, pa.float64())

    return run
