"""Counts, sums and products of all column pairs as arrays that can be merged.

A task reads its rows once and keeps one set of square arrays for each group:
for every pair of columns the number of rows in which both are present, the sum
of the first, of its square, and of the product, all less a shift near the mean.
One row for each group and task is shuffled, and no value.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import importable_by_workers

FAN_IN = 64
STATE = "unit long, part int, state binary"


@dataclass(frozen=True)
class Moments:
    """``shift`` of each column, and arrays over pairs (i, j) of rows in which both are present."""

    shift: np.ndarray
    count: np.ndarray
    first: np.ndarray
    square: np.ndarray
    product: np.ndarray

    @classmethod
    def of(cls, values: np.ndarray) -> Moments:
        """Of rows x columns, NaN where a value is missing."""
        present = ~np.isnan(values)
        held = np.where(present, values, 0.0)
        shift = held.sum(0) / np.maximum(present.sum(0), 1)
        held = np.where(present, values - shift, 0.0)
        mask = present.astype(float)
        return cls(shift, mask.T @ mask, held.T @ mask, (held * held).T @ mask, held.T @ held)

    def shifted(self, to: np.ndarray) -> Moments:
        d = (self.shift - to)[:, None]
        n, s = self.count, self.first
        square = self.square + 2 * d * s + d * d * n
        product = self.product + d * s.T + d.T * s + d * d.T * n
        return Moments(to, n, s + d * n, square, product)

    def merged(self, other: Moments) -> Moments:
        mine, theirs = self, other.shifted(self.shift)
        return Moments(self.shift, *(a + b for a, b in zip(mine._arrays(), theirs._arrays())))

    def _arrays(self) -> tuple[np.ndarray, ...]:
        return self.count, self.first, self.square, self.product

    def to_bytes(self) -> bytes:
        return np.concatenate([self.shift, *(a.ravel() for a in self._arrays())]).tobytes()

    @classmethod
    def from_bytes(cls, state: bytes) -> Moments:
        flat = np.frombuffer(state)
        width = int((np.sqrt(1 + 16 * len(flat)) - 1) / 8 + 0.5)
        return cls(flat[:width], *flat[width:].reshape(4, width, width))

    def means(self) -> np.ndarray:
        count = np.diag(self.count)
        return self.shift + np.divide(np.diag(self.first), count, out=np.full(len(count), np.nan), where=count > 0)

    def covariance_sums(self) -> np.ndarray:
        """Sums of products of deviations from the means of the rows that both columns have."""
        n = np.maximum(self.count, 1)
        return self.product - self.first * self.first.T / n

    def correlations(self) -> np.ndarray:
        """Pearson's r of every pair, NaN where one of the columns does not vary."""
        n = np.maximum(self.count, 1)
        spread = self.square - self.first**2 / n
        # What rounding leaves of a column without spread is none.
        spread = np.where(spread <= 1e-13 * np.maximum(self.square, 1e-300), 0.0, spread)
        with np.errstate(all="ignore"):
            r = self.covariance_sums() / np.sqrt(spread * spread.T)
        np.fill_diagonal(r, np.where(np.diag(spread) > 0, 1.0, np.nan))
        return np.where(spread * spread.T > 0, r, np.nan)


def pair_moments(df: DataFrame, columns: Sequence[str], unit: Column | None = None) -> dict[int, Moments]:
    """The moments of all column pairs by ``unit`` (a small number of longs): one scan, and as many rows as units."""
    importable_by_workers(df.sparkSession)
    names = [f"c{i}" for i in range(len(columns))]
    rows = df.select(
        (F.lit(0) if unit is None else unit).cast("long").alias("unit"),
        *[F.col(c).cast("double").alias(n) for c, n in zip(columns, names)],
    )

    def batch_rows(units: list[int], parts: list[int], states: list[bytes]) -> pa.RecordBatch:
        arrays = [pa.array(units, pa.int64()), pa.array(parts, pa.int32()), pa.array(states, pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, names=["unit", "part", "state"])

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, Moments] = {}
        for batch in batches:
            units = batch.column("unit").to_numpy()
            values = np.column_stack([batch.column(n).to_numpy(zero_copy_only=False).astype(float) for n in names])
            for u in np.unique(units).tolist():
                found = Moments.of(values[units == u])
                total[u] = total[u].merged(found) if u in total else found
        part = TaskContext.get().partitionId() % FAN_IN
        yield batch_rows(list(total), [part] * len(total), [m.to_bytes() for m in total.values()])

    def merge(table: pa.Table) -> pa.Table:
        states = sorted(table.column("state").to_pylist())
        total = Moments.from_bytes(states[0])
        for state in states[1:]:
            total = total.merged(Moments.from_bytes(state))
        unit, part = table.column("unit")[0].as_py(), table.column("part")[0].as_py()
        return pa.Table.from_batches([batch_rows([unit], [part], [total.to_bytes()])])

    # In two steps, so that no group holds a row of every task.
    some = rows.mapInArrow(collect, STATE).groupBy("unit", "part").applyInArrow(merge, STATE)
    whole = some.groupBy("unit").applyInArrow(merge, STATE)
    return {r["unit"]: Moments.from_bytes(r["state"]) for r in whole.collect()}
