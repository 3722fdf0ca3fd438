"""The state machine of ``operators.history`` over a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.history import COLUMNS, OUT, Machine, frame, rows


def observe(observations: DataFrame, key: str, ts: str = "ts", outcome: str = "outcome", seen: str = "hash", tools: str = "tools") -> DataFrame:
    """History events of a stream of observations, in append mode.

    Within a micro-batch a key's observations are taken in the order of their time; the
    order of batches is that of the runs. A batch's rows of a key are at hand at once,
    its past is the state alone.
    """
    kind = observations.schema[key].dataType.simpleString()

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        machine = Machine.load(state.get[0]) if state.exists else Machine()
        batch = pd.concat(list(batches)).sort_values([ts, outcome, seen])
        found = rows(machine, batch[[ts, outcome, seen, tools]].itertuples(index=False), {key: k[0]})
        state.update((machine.dump(),))
        if found:
            yield frame(found, (key, *COLUMNS))

    return observations.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {OUT}", "state string", "append", GroupStateTimeout.NoTimeout)


def first_seen(rows: DataFrame, key: str) -> DataFrame:
    """Each key once over all runs; the keys are the stream's state."""
    return rows.dropDuplicates([key])
