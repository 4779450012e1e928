"""Sequential work on many small groups, whole groups to an Arrow table instead of a Python call per group."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame


def _starts(t: pa.Table, keys: list[str]) -> np.ndarray:
    """The first row of each run of equal keys; nulls are equal."""
    new = np.zeros(t.num_rows, dtype=bool)
    new[:1] = True
    for k in keys:
        codes = pc.dictionary_encode(t.column(k).combine_chunks(), null_encoding="encode").indices.to_numpy()
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


def by_group(rows: DataFrame, keys: list[str], order: list[str], schema: str, make: Callable[[pa.Table, np.ndarray], pa.RecordBatch]) -> DataFrame:
    """``make`` gets tables of whole groups, sorted by keys and order, with the groups' bounds (groups + 1 numbers).

    One shuffle by the keys; a group must fit a task, groups are not held beyond an Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            t = t if rest is None else pa.concat_tables([rest, t])
            starts = _starts(t, keys)
            if len(starts) > 1:
                yield make(t.slice(0, int(starts[-1])).combine_chunks(), starts)
            rest = t.slice(int(starts[-1]))
        if rest is not None:
            yield make(rest.combine_chunks(), np.array([0, rest.num_rows]))

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
