"""Groups of rows in sorted partitions, one after another: a group is never a Python call or a data frame of its own."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Rows that are worked on together, at least, so that a call has many groups.
ROWS = 50_000


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Frames of many rows that end where a group ends. Rows come sorted by the keys; each is copied once.

    Only a batch's own rows are looked at, so the time is linear however long a group is.
    """
    held: list[pd.DataFrame] = []
    rows, last = 0, None
    for batch in batches:
        if not len(batch):
            continue
        now = tuple(batch[k].iloc[-1] for k in keys)
        if rows + len(batch) >= ROWS:
            same = np.logical_and.reduce([(batch[k] == v).to_numpy() for k, v in zip(keys, now, strict=True)])
            cut = len(batch) - int(np.argmin(same[::-1])) if not same.all() else 0
            if cut or last not in (None, now):
                yield pd.concat([*held, batch.iloc[:cut]], ignore_index=True)
                held, rows, batch = [], 0, batch.iloc[cut:]
        held.append(batch)
        rows, last = rows + len(batch), now
    if rows:
        yield pd.concat(held, ignore_index=True)


def starts(frame: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """Where each group begins, and the number of rows."""
    new = np.zeros(len(frame), bool)
    new[:1] = True
    for k in keys:
        values = frame[k].to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return np.append(np.flatnonzero(new), len(frame))


def map_groups(df: DataFrame, keys: list[str], work: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame], schema: str, order: tuple[str, ...] = ()) -> DataFrame:
    """Deal rows out by the keys and call work(frame, starts) on frames of whole groups."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_groups(batches, keys):
            frame = frame.reset_index(drop=True)
            yield work(frame, starts(frame, keys))

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
