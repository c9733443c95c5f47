"""Running values along sorted segments of any length.

The rows are range-partitioned and sorted by segment and order.  A step of a running value is ``y = max(least, y + add)``;
two steps one after the other are one step of the same form, so a slice of a long segment is summarised by two numbers.  One
summary per slice reaches the driver, which hands every slice the value that it starts with; no task sees a whole segment.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

NEVER = float("-inf")


@dataclass(frozen=True)
class Running:
    """A running value ``name``, from 0 at the start of a segment; ``name_before`` is its value before the row's step.

    ``add`` and ``least`` are columns of doubles; without ``least`` the value is a plain sum.
    """

    name: str
    add: str
    least: str = ""

    def steps(self, batch: pa.RecordBatch) -> tuple[list, list]:
        add = batch.column(self.add).to_pylist()
        return add, batch.column(self.least).to_pylist() if self.least else [NEVER] * len(add)


def _summaries(segment: str, values: Sequence[Running]):
    """Per slice: its last segment, whether that began in an earlier slice as far as can be told here, and its steps as one."""

    def run(batches: Iterator[pa.RecordBatch]):
        first = last = None
        state = [[NEVER, 0.0] for _ in values]
        for batch in batches:
            keys = batch.column(segment).to_pylist()
            for k, value in enumerate(values):
                least, add = state[k]
                at = last
                for key, b, a in zip(keys, *value.steps(batch)):
                    if key != at:
                        least, add, at = NEVER, 0.0, key
                    least, add = max(a, least + b), add + b
                state[k] = [least, add]
            if keys:
                first, last = (keys[0] if first is None else first), keys[-1]
        if first is not None:
            yield pa.RecordBatch.from_pydict({
                "slice": pa.array([TaskContext.get().partitionId()], pa.int64()), "first": pa.array([first], pa.int64()), "last": pa.array([last], pa.int64()),
                "steps": pa.array([[x for pair in state for x in pair]], pa.list_(pa.float64()))})

    return run


def _apply(segment: str, values: Sequence[Running], carried: dict[int, tuple[int, list[float]]]):
    def run(batches: Iterator[pa.RecordBatch]):
        at, now = carried.get(TaskContext.get().partitionId(), (None, [0.0] * len(values)))
        now = list(now)
        for batch in batches:
            keys, columns = batch.column(segment).to_pylist(), []
            for k, value in enumerate(values):
                before, after, y, here = [], [], now[k], at
                for key, b, a in zip(keys, *value.steps(batch)):
                    if key != here:
                        y, here = 0.0, key
                    before.append(y)
                    y = max(a, y + b)
                    after.append(y)
                now[k] = y
                columns += [pa.array(after, pa.float64()), pa.array(before, pa.float64())]
            at = keys[-1] if keys else at
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns],
                                             names=[*batch.schema.names, *[n for v in values for n in (v.name, f"{v.name}_before")]])

    return run


def running(slices: DataFrame, segment: str, values: Sequence[Running]) -> DataFrame:
    """``slices`` with the running ``values``, in the same partitions.

    ``slices`` is the result of :func:`ionweave.session.sorted_slices` by ``segment`` (a long) and an order, or of this
    function: its partitions have to be fixed.
    """
    found = slices.mapInArrow(_summaries(segment, values), "slice long, first long, last long, steps array<double>").collect()
    carried, at, now = {}, None, [0.0] * len(values)
    for row in sorted(found, key=lambda r: r["slice"]):
        carried[row["slice"]] = (at, now)
        start = now if row["first"] == row["last"] == at else [0.0] * len(values)
        steps = row["steps"]
        at, now = row["last"], [max(steps[2 * k], start[k] + steps[2 * k + 1]) for k in range(len(values))]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in slices.schema.fields]
    fields += [f"{n} double" for v in values for n in (v.name, f"{v.name}_before")]
    return slices.mapInArrow(_apply(segment, values, carried), ", ".join(fields))
