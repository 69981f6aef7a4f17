"""Description text that builds up while frames come in, with one small state for each program."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    text, armed, done = state.get if state.exists else ("", False, False)
    rows = pd.concat(list(frames)).sort_values("position")
    for ch in rows["ch"].tolist():
        if done or not ch:
            continue
        text += chr(ch)
        done = armed and ch == 3
        armed = armed or ch == 2
    state.update((text, armed, done))
    yield pd.DataFrame({"program": [key[0]], "text": [text], "complete": [done]})


def description_stream(chars: DataFrame) -> DataFrame:
    """``program, text, complete`` after each batch of (program, position, ch): every non-zero character until an end (3) that follows a start (2).

    Batches come in order of position, as a growing file's do; the state holds a program's text alone.
    """
    return chars.groupBy("program").applyInPandasWithState(_step, "program long, text string, complete boolean", "text string, armed boolean, done boolean", "update", GroupStateTimeout.NoTimeout)
