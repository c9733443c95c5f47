"""Splitting clusters into precursor-mass groups.

Both rules walk a cluster's masses in ascending order.  To keep one very large cluster from running in one task, the distinct
masses are range-partitioned into sorted slices.  A slice is summarised as a function: given the group that is open before
it, which one is open after it.  By gap that is the same group or a group of its own; by anchor it is a step function of the
incoming anchor, since anchors that the slice treats alike lead to one last anchor.  The functions are applied one after the other
on the driver, and then every slice is walked once with the group that it starts in.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Iterator, Optional

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionweave.session import ordered_index, sorted_slices


@dataclass(frozen=True)
class Open:
    """The group still open after a row: its cluster, first mass and latest mass."""

    label: int
    start: float
    last: float


def _segment_starts(label: np.ndarray, mass: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """True where a row certainly opens a group: other cluster, or a step over the limit."""
    first = np.ones(len(mass), dtype=bool)
    if len(mass) > 1:
        first[1:] = (label[1:] != label[:-1]) | (mass[1:] - mass[:-1] > limit[:-1])
    return first


def walk_gap(label, mass, gap: float, carry: Optional[Open]):
    """Group start per row where a group ends at a step above ``gap``."""
    first = _segment_starts(label, mass, np.full(len(mass), gap))
    starts = mass[np.maximum.accumulate(np.where(first, np.arange(len(mass)), 0))].copy()
    if carry is not None and carry.label == label[0] and mass[0] - carry.last <= gap:
        stop = np.flatnonzero(first[1:])
        starts[: stop[0] + 1 if len(stop) else len(mass)] = carry.start
    return starts, Open(int(label[-1]), float(starts[-1]), float(mass[-1]))


def walk_anchor(label, mass, ppm: float, carry: Optional[Open]):
    """Group start per row where a group spans at most ``ppm`` above its lightest mass.

    A step above the tolerance of the mass before it opens a group under any anchor,
    so only runs without such a step that are wider than one tolerance need stepping.
    """
    tol = mass * ppm * 1e-6
    bounds = np.append(np.flatnonzero(_segment_starts(label, mass, tol)), len(mass))
    starts = np.repeat(mass[bounds[:-1]], np.diff(bounds))
    wide = mass[bounds[1:] - 1] - mass[bounds[:-1]] > tol[bounds[:-1]]
    carried = carry is not None and carry.label == label[0]
    for seg in np.flatnonzero(wide) if not carried else np.union1d(np.flatnonzero(wide), [0]):
        at, end = int(bounds[seg]), int(bounds[seg + 1])
        anchor = carry.start if carried and seg == 0 else float(mass[at])
        while at < end:
            reach = anchor * ppm * 1e-6
            stop = at + int(np.searchsorted(mass[at:end], anchor + reach, side="right"))
            while stop < end and mass[stop] - anchor <= reach:  # rounding of anchor + reach
                stop += 1
            while stop > at and mass[stop - 1] - anchor > reach:
                stop -= 1
            starts[at:stop] = anchor
            at = stop
            anchor = float(mass[at]) if at < end else anchor
    return starts, Open(int(label[-1]), float(starts[-1]), float(mass[-1]))


def next_anchors(mass: np.ndarray, ppm: float) -> np.ndarray:
    """Position of the first mass out of reach of every mass, for ascending masses."""
    reach = mass * ppm * 1e-6
    after = np.searchsorted(mass, mass + reach, side="right")
    padded = np.append(mass, np.inf)
    while True:  # rounding of mass + reach
        low = (after < len(mass)) & (padded[after] - mass <= reach)
        high = ~low & (mass[after - 1] - mass > reach)
        if not low.any() and not high.any():
            return after
        after = after + low - high


@dataclass(frozen=True)
class GapRule:
    """Groups end at a step above ``gap``."""

    gap: float

    def walk(self, label, mass, carry: Optional[Open]):
        return walk_gap(label, mass, self.gap, carry)

    def breaks(self, mass: np.ndarray) -> bool:
        return bool((np.diff(mass) > self.gap).any())

    def steps(self, mass: np.ndarray) -> tuple[list, list]:
        return [], []

    def hand(self, row, carry: Open) -> float:
        return carry.start if row["first"] - carry.last <= self.gap else row["start"]


@dataclass(frozen=True)
class AnchorRule:
    """Groups span at most ``ppm`` above their lightest mass."""

    ppm: float

    def walk(self, label, mass, carry: Optional[Open]):
        return walk_anchor(label, mass, self.ppm, carry)

    def breaks(self, mass: np.ndarray) -> bool:
        return bool((np.diff(mass) > mass[:-1] * self.ppm * 1e-6).any())

    def steps(self, mass: np.ndarray) -> tuple[list, list]:
        """``(entries, anchors)``: where a walk's first own anchor is at most ``entries[k]``, its last one is ``anchors[k]``.

        Only anchors within reach of the first mass can come in, so only own anchors in one more reach can be the first.
        """
        after = next_anchors(mass, self.ppm)
        last = np.where(after >= len(mass), np.arange(len(mass)), after)
        while True:
            further = last[last]
            if np.array_equal(further, last):
                break
            last = further
        width = min(len(mass), int(after[0]) + 1)
        ends = np.append(np.flatnonzero(np.diff(last[:width])), width - 1)
        return mass[ends].tolist(), mass[last[ends]].tolist()

    def hand(self, row, carry: Open) -> float:
        reach = carry.start * self.ppm * 1e-6
        return next((anchor for entry, anchor in zip(row["entries"], row["anchors"]) if entry - carry.start > reach), carry.start)


def _slice_starts(slices: DataFrame, rule) -> DataFrame:
    """``(label, mass, start)`` for the sorted slices: one job for their summaries, one walk."""

    def summary(batches: Iterator[pa.RecordBatch]):
        held = [(b.column("label").to_numpy(zero_copy_only=False), b.column("mass").to_numpy(zero_copy_only=False)) for b in batches if b.num_rows]
        if held:
            label, mass = (np.concatenate(part) for part in zip(*held))
            starts, state = rule.walk(label, mass, None)
            whole = label[0] == label[-1] and not rule.breaks(mass)
            entries, anchors = rule.steps(mass) if whole else ([], [])
            yield pa.RecordBatch.from_arrays(
                [pa.array([x]) for x in (TaskContext.get().partitionId(), int(label[0]), float(mass[0]), bool(whole))]
                + [pa.array([x]) for x in (state.label, state.start, state.last)] + [pa.array([x], pa.list_(pa.float64())) for x in (entries, anchors)],
                names=["pid", "head", "first", "whole", "label", "start", "last", "entries", "anchors"])

    schema = "pid long, head long, first double, whole boolean, label long, start double, last double, entries array<double>, anchors array<double>"
    carries: dict[int, Open] = {}
    carry: Optional[Open] = None
    for row in sorted(slices.mapInArrow(summary, schema).collect(), key=lambda r: r["pid"]):
        mine = carry is not None and carry.label == row["head"]
        if mine:
            carries[row["pid"]] = carry
        carry = Open(row["label"], rule.hand(row, carry) if mine and row["whole"] else row["start"], row["last"])

    def assign(batches: Iterator[pa.RecordBatch]):
        state = carries.get(TaskContext.get().partitionId())
        for batch in batches:
            if batch.num_rows:
                label, mass = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("label", "mass"))
                starts, state = rule.walk(label, mass, state)
                yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("mass"), pa.array(starts, pa.float64())],
                                                 names=["label", "mass", "start"])

    return slices.mapInArrow(assign, "label long, mass double, start double")


def _split(rows: DataFrame, rule) -> DataFrame:
    # many rows of one cluster may share a mass: walk the distinct masses only
    distinct = rows.groupBy(F.col("label").cast("bigint").alias("label"), "mass").agg(F.count("*").alias("_n"))
    starts = _slice_starts(sorted_slices(distinct.select("label", "mass"), "label", "mass"), rule)
    return rows.join(starts, ["label", "mass"])


def anchored_groups(rows: DataFrame, ppm: float) -> DataFrame:
    """Adds the group key ``(start, solo)`` to rows ``(label, idx, mass)``.

    A negative mass (missing precursor) has a negative tolerance, so each such row is a
    group of its own, told apart by ``solo``.
    """
    rows = rows.withColumn("label", F.col("label").cast("bigint"))
    plain = _split(rows.filter(F.col("mass") >= 0), AnchorRule(ppm))
    solo = rows.filter(F.col("mass") < 0).withColumn("start", F.col("mass")).withColumn("solo", F.col("idx"))
    return plain.withColumn("solo", F.lit(-1).cast("bigint")).unionByName(solo)


def gap_groups(rows: DataFrame, gap: float) -> DataFrame:
    """Adds the group key for groups that end at a mass step above ``gap``."""
    rows = rows.withColumn("label", F.col("label").cast("bigint"))
    return (_split(rows, GapRule(gap))
            .withColumn("solo", F.lit(-1).cast("bigint")))


def mass_groups(rows: DataFrame, ppm: float = 10.0, gap_da: float = 0.5) -> DataFrame:
    """Group key per row: anchored when ``ppm`` > 0, else by gap."""
    return anchored_groups(rows, ppm) if ppm and ppm > 0 else gap_groups(rows, gap_da)


def numbered_groups(grouped: DataFrame) -> DataFrame:
    """Group table ``(label, start, solo, pos, grp)``: overall position and 0-based number in its label."""
    groups = grouped.groupBy("label", "start", "solo").agg(F.count("*").alias("n_members"))
    indexed = ordered_index(groups, "label", "start", "solo")
    first = indexed.groupBy("label").agg(F.min("pos").alias("_first"), F.count("*").alias("n_groups"))
    return indexed.join(first, "label").withColumn("grp", F.col("pos") - F.col("_first")).drop("_first")


def number_rows(grouped: DataFrame) -> DataFrame:
    """Rows with their 0-based group number inside the label."""
    numbers = numbered_groups(grouped).select("label", "start", "solo", "grp")
    return grouped.join(numbers, ["label", "start", "solo"])


def gap_post_split(labels: DataFrame, gap: float = 1.5) -> DataFrame:
    """Split labels ``(idx, label, precursor_mz)`` at m/z gaps; the first group keeps its id.

    Further groups get fresh ids after the largest label, in label and m/z order.
    Noise rows pass through.
    """
    noise = labels.filter("label < 0").select("idx", F.col("label").cast("bigint").alias("label"))
    rows = labels.filter("label >= 0").select("idx", "label", F.col("precursor_mz").alias("mass"))
    grouped = gap_groups(rows, gap)
    groups = numbered_groups(grouped).select("label", "start", "solo", "grp")
    extra = ordered_index(groups.filter("grp > 0"), "label", "start", name="nth")
    top = labels.agg(F.max("label").alias("top")).first()["top"]
    ids = (groups.join(extra.select("label", "start", "nth"), ["label", "start"], "left")
           .select("label", "start", F.coalesce(F.col("nth") + F.lit((top or 0) + 1), "label").alias("new_label")))
    return grouped.join(ids, ["label", "start"]).select("idx", F.col("new_label").alias("label")).unionByName(noise)
