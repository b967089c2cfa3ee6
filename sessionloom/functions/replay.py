"""Ordered per-key state machines over sorted partitions.

Used only where the next state truly depends on the previous one.  Rows arrive in order, batch by
batch; a task holds one batch and the state of one key, never a whole group.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame


def replay(df: DataFrame, keys: Sequence[str], order: Sequence[str], machine: Callable, schema: str) -> DataFrame:
    """Feed each key's rows in ``order`` to a fresh ``machine(key)``; its ``step`` and ``finish`` return rows."""
    names = [part.split()[0] for part in schema.split(",")]
    keys = list(keys)

    def run(batches):
        current, live = None, None
        for pdf in batches:
            out: list[tuple] = []
            for row in pdf.itertuples(index=False):
                key = tuple(getattr(row, k) for k in keys)
                if key != current:
                    if live is not None:
                        out.extend(live.finish())
                    current, live = key, machine(key)
                out.extend(live.step(row))
            yield pd.DataFrame(out, columns=names)
        if live is not None:
            yield pd.DataFrame(live.finish(), columns=names)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
