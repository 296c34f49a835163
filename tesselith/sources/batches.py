"""Rows in batches for functions that need many at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Rows and bytes of a batch at most.
BATCH_ROWS, BATCH_BYTES = 1_000_000, 32 << 20


def map_batches(df: DataFrame, work: Callable[[pd.DataFrame], pd.DataFrame], schema: str, rows: int = BATCH_ROWS, nbytes: int = BATCH_BYTES) -> DataFrame:
    """work(batch) for batches of up to ``rows`` rows and about ``nbytes`` bytes; the last batch of a task may be smaller.

    A batch never crosses tasks and an empty task has none; one Arrow batch is the least that is read at once, so it
    bounds what nbytes can reach. Nulls and repeated rows are passed on as they are.
    """
    if rows < 1:
        raise ValueError("a batch has at least one row")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        count = size = 0
        for pdf in parts:
            for start in range(0, len(pdf), rows):
                piece = pdf.iloc[start : start + rows]
                piece_size = int(piece.memory_usage(index=False, deep=True).sum())
                if held and (count + len(piece) > rows or size + piece_size > nbytes):
                    yield work(pd.concat(held, ignore_index=True))
                    held, count, size = [], 0, 0
                held.append(piece)
                count, size = count + len(piece), size + piece_size
        if held:
            yield work(pd.concat(held, ignore_index=True))

    return df.mapInPandas(run, schema)
