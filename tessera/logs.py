"""What was called, with what, for how long, and what a frame holds, as lines of JSON in Python's logging."""

from __future__ import annotations

import functools
import json
import logging
import time
from collections.abc import Callable
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame

LOG = logging.getLogger("tessera")


def short(value: Any, most: int = 200) -> str:
    """A value for a log: a frame by its columns (it isn't run), anything else by its repr, cut."""
    text = f"DataFrame[{', '.join(value.columns)}]" if isinstance(value, DataFrame) else repr(value)
    return text if len(text) <= most else text[: most - 3] + "..."


def log_json(event: str, **fields: Any) -> None:
    LOG.info(json.dumps({"event": event} | fields, default=short))


@contextmanager
def timed(event: str, **fields: Any):
    """Logs how long a block took, and the error that ended it."""
    began = time.perf_counter()
    try:
        yield
    except Exception as e:
        log_json(event, **fields, seconds=round(time.perf_counter() - began, 3), error=f"{type(e).__name__}: {e}")
        raise
    log_json(event, **fields, seconds=round(time.perf_counter() - began, 3))


def log_call(f: Callable | None = None, *, when: Callable[[], bool] = lambda: True):
    """A decorator: each call's arguments and seconds. when: whether a call is logged."""

    def wrap(g: Callable) -> Callable:
        @functools.wraps(g)
        def call(*a, **k):
            if not when():
                return g(*a, **k)
            with timed(g.__qualname__, arguments=[short(x) for x in a] + [f"{n}={short(x)}" for n, x in k.items()]):
                return g(*a, **k)

        return call

    return wrap(f) if f is not None else wrap


def log_frame(df: DataFrame, name: str, rows: int = 5) -> DataFrame:
    """A frame's schema and first rows, logged; only those rows are computed."""
    log_json("frame", name=name, schema={f.name: f.dataType.simpleString() for f in df.schema}, rows=[short(r.asDict()) for r in df.limit(rows).collect()])
    return df
