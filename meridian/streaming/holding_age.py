"""The holding-age recurrence over a stream of daily rows: one pair of numbers of state per code.

Rows may come in any order within a micro-batch; a day at or before the last one seen for its code is late and is left
out. A batch run over the same rows (``operators.factors.chip_age``) gives the same ages.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "di int, code string, age double"
STATE = "di int, age double"


def _advance(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last, age = state.get if state.exists else (-1, 0.0)
    out = []
    for day in pd.concat(list(rows)).sort_values("di").drop_duplicates("di").itertuples():
        if day.di <= last:
            continue
        turn = 0.0 if pd.isna(day.turn) else min(max(day.turn, 0.0), 1.0)
        last, age = int(day.di), (1.0 - turn) * (age + 1.0)
        out.append((last, key[0], age))
    state.update((last, age))
    yield pd.DataFrame(out, columns=["di", "code", "age"])


def holding_age(stream: DataFrame) -> DataFrame:
    """``di, code, age`` of a stream with ``di, code, turn``; every calendar day of a code must come once (null turnover counts as none)."""
    return stream.select("di", "code", "turn").groupBy("code").applyInPandasWithState(_advance, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
