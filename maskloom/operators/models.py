"""Where model calls enter: a batch function per worker, applied after all cheap filters."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Models of this Python process, by the name under which they were loaded; tasks that Spark gives to the process find them here.
_HELD: dict[str, Callable] = {}

#: Models that a process holds at once; the one loaded first goes.
HELD = 4


def held(name: str, load: Callable[[], Callable]) -> Callable:
    """The model of that name, loaded if this process does not have it."""
    if name not in _HELD:
        while len(_HELD) >= HELD:
            _HELD.pop(next(iter(_HELD)))
        _HELD[name] = load()
    return _HELD[name]


def apply_batch_model(df: DataFrame, load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str, name: str | None = None) -> DataFrame:
    """Call load once per worker process and the function it returns once per Arrow batch.

    name: what the model is known by in the workers; jobs that give the same name share it. A process without rows loads nothing.
    """
    known_as = name or uuid.uuid4().hex

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield held(known_as, load)(batch)

    return df.mapInPandas(run, schema)
