"""Sequential folds over many small groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

Fold = Callable[[pd.DataFrame], pd.DataFrame]


def fold_groups(df: DataFrame, key: str, order: list[str], columns: list[str], fold: Fold, schema: str, many: bool = False) -> DataFrame:
    """*fold* over each key's rows in *order*, all groups of a partition in one pass.

    Rows are dealt by key and sorted within partitions, so a batch holds many whole groups and only its last one may go on in
    the next. That spares the fixed cost that a grouped function has for every group. Null keys are one group. With *many* the fold gets all whole groups
    of a batch at once, and tells them apart itself.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # parts of the last group, which may go on in the next batch; joined once, when it has ended
        for rows in batches:
            if not len(rows):
                continue
            k = rows[key]
            before = k.shift(fill_value=held[-1][key].iat[-1] if held else k.iat[0])
            start = np.flatnonzero(~((k == before) | (k.isna() & before.isna())).to_numpy() | (np.arange(len(rows)) == 0) & (not held))
            if many:
                if len(start):
                    if held or start[-1]:
                        yield fold(pd.concat([*held, rows.iloc[: start[-1]]], ignore_index=True))
                    held = []
                held.append(rows.iloc[start[-1] :] if len(start) else rows)
                continue
            if held and len(start):
                yield fold(pd.concat([*held, rows.iloc[: start[0]]], ignore_index=True))
                held = []
            done = [fold(rows.iloc[a:b].reset_index(drop=True)) for a, b in zip(start[:-1], start[1:], strict=True)]
            held.append(rows.iloc[start[-1] :] if len(start) else rows)
            if done:
                yield pd.concat(done, ignore_index=True)
        if held:
            yield fold(pd.concat(held, ignore_index=True))

    wanted = list(dict.fromkeys([key, *order, *columns]))
    return df.select(*wanted).repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)
