"""Ordered folds: recurrences that no window can express, with constant memory per series.

Rows are dealt by key and sorted, then read batch by batch; only the state of the current series is
held, so a series may be longer than any task's memory. The step functions are shared with the
streaming processors, so batch and stream give the same values.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fold(df: DataFrame, inputs: list[str], step, outputs: dict[str, str], key: str = "symbol", order: str = "ts", then: tuple[str, ...] = ()) -> DataFrame:
    """step(state, *inputs) -> (state, outputs); state is None at a series' first row. Adds the outputs to key and order; the inputs `then` order rows of equal order."""
    names = list(outputs)
    kinds = dict(df.dtypes)
    schema = f"{key} {kinds[key]}, {order} {kinds[order]}, " + ", ".join(f"{n} {t}" for n, t in outputs.items())

    def each(frames):
        state, current = None, object()
        for frame in frames:
            rows = []
            for k, *xs in zip(frame[key], *[frame[c] for c in inputs]):
                if k != current:
                    state, current = None, k
                state, values = step(state, *xs)
                rows.append(values)
            out = pd.DataFrame(rows, columns=names) if rows else pd.DataFrame({n: [] for n in names})
            out.insert(0, order, frame[order].to_numpy())
            out.insert(0, key, frame[key].to_numpy())
            yield out

    ready = df.select(key, order, *[F.col(c) for c in inputs]).repartition(key).sortWithinPartitions(key, order, *then)
    return ready.mapInPandas(each, schema)
