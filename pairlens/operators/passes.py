"""Sums of arrays over all rows: the passes of fits that need many sums at once."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame

#: Parts of sums that the driver adds up; more are added in tasks first.
PARTS = 64


def added(parts: DataFrame) -> np.ndarray:
    """The sum of the arrays in the rows' column s."""

    def add(it):
        total = None
        for batch in it:
            for value in batch.column(0).to_pylist():
                got = np.frombuffer(value)
                total = got.copy() if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["s"])

    rows = parts.collect() if parts.rdd.getNumPartitions() <= PARTS else parts.repartition(PARTS).mapInArrow(add, "s binary").collect()
    return np.sum([np.frombuffer(r["s"]) for r in rows], axis=0)


def summed(rows: RDD, run: Callable[[Iterable], Iterable[np.ndarray]]) -> np.ndarray:
    """The sum of the arrays that run makes of each partition. A table's RDD is planned once, so a pass of many costs little beside its rows."""

    def add(it):
        arrays = list(it)
        return [np.sum(arrays, axis=0)] if arrays else []

    parts = rows.mapPartitions(run)
    return np.sum((parts if rows.getNumPartitions() <= PARTS else parts.repartition(PARTS).mapPartitions(add)).collect(), axis=0)
