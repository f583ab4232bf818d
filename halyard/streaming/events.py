"""Threshold events of histories that arrive row by row.

The re-arming counter of operators/transfer.py as a stateful operator: one short state a
history. Rows of a history come in order of t from file to file; inside a batch they are sorted.
A row that is not later than the last one seen is late and changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import ship_code


def running_threshold_events(stream: DataFrame, high: float, low: float) -> DataFrame:
    """h, t (last row seen), n_events so far; stream: h, t, d (donor), a (acceptor)."""
    if not low < high:
        raise ValueError("the low threshold must be below the high one")
    ship_code(stream.sparkSession)

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        armed, n, last = state.get if state.exists else (False, 0, -1)
        rows = pd.concat(list(batches)).sort_values("t")
        for t, d, a in zip(rows["t"], rows["d"], rows["a"]):
            if t <= last:
                continue
            last = int(t)
            if d >= high:
                armed = True
            elif armed and d <= low and a >= low:
                armed, n = False, n + 1
        state.update((armed, n, last))
        yield pd.DataFrame({"h": [key[0]], "t": [last], "n_events": [n]})

    return stream.groupBy("h").applyInPandasWithState(
        update, "h int, t int, n_events int", "armed boolean, n int, last int", "update", GroupStateTimeout.NoTimeout
    )
