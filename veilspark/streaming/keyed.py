"""Keyed state for streams: the same small state machines as the batch walks, one state per key."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def keyed_state(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    step: Callable[[dict, dict], list[tuple]],
    out_schema: str,
    on_timeout: Callable[[dict, tuple], list[tuple]] | None = None,
    timer: Callable[[dict], int | None] | None = None,
) -> DataFrame:
    """Fold each micro-batch in order into a JSON state per key.

    ``step(state, row)`` changes the state and returns output rows.  With ``timer`` (event time in ms,
    needs a watermark) ``on_timeout(state, key)`` runs when the watermark passes it, and the state ends.
    """
    names = [c.strip().split()[0] for c in out_schema.split(",")]

    def run(key: tuple, frames: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        state = json.loads(group.get[0]) if group.exists else {}
        out: list[tuple] = []
        if group.hasTimedOut:
            out = on_timeout(state, key) if on_timeout else []
            group.remove()
        else:
            rows = [dict(zip(pdf.columns, r)) for pdf in frames for r in zip(*(pdf[c].tolist() for c in pdf.columns))]
            rows.sort(key=lambda r: tuple(r[c] for c in order))
            for row in rows:
                out.extend(step(state, row))
            group.update((json.dumps(state),))
            at = timer(state) if timer else None
            if at is not None:
                group.setTimeoutTimestamp(max(at, group.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=names)

    timeout = GroupStateTimeout.EventTimeTimeout if timer else GroupStateTimeout.NoTimeout
    return df.groupBy(*keys).applyInPandasWithState(run, out_schema, "state string", "append", timeout)


#: Rows of a frame that a fold gives back at once.
SLICE = 50_000


def keyed_columns(df: DataFrame, keys: list[str], order: str, fold: Callable[[dict, dict[str, list]], dict[str, list]], out_schema: str) -> DataFrame:
    """:func:`keyed_state` for keys with very many rows: ``fold(state, columns)`` takes those of a micro-batch as columns in the order of ``order``.

    It changes the state and returns the columns of ``out_schema`` without the keys, which come first in it.
    """
    names = [c.strip().split()[0] for c in out_schema.split(",")]
    given = [c for c in df.columns if c not in keys]

    def run(key: tuple, frames: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        state = json.loads(group.get[0]) if group.exists else {}
        columns: dict[str, list] = {c: [] for c in given}
        for pdf in frames:
            for c in given:
                columns[c] += pdf[c].tolist()
        ranks = sorted(range(len(columns[order])), key=columns[order].__getitem__)
        for c in given:
            columns[c] = [columns[c][i] for i in ranks]
        out = fold(state, columns)
        group.update((json.dumps(state),))
        rows = len(out[names[-1]])
        for at in range(0, rows, SLICE):
            part = {c: out[c][at : at + SLICE] for c in names[len(keys):]}
            yield pd.DataFrame({**{k: [v] * len(part[names[-1]]) for k, v in zip(names, key)}, **part})

    return df.groupBy(*keys).applyInPandasWithState(run, out_schema, "state string", "append", GroupStateTimeout.NoTimeout)
