"""Operators over the long peak table ``(idx, mz, intensity)``.

Each one pre-aggregates or limits before its shuffle, so a spectrum with very many
peaks never has to sit in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ionweave.functions import peaks as P
from ionweave.session import checkpoint


def explode_peaks(spectra: DataFrame) -> DataFrame:
    """Long peak table of spectrum rows with peak arrays."""
    return spectra.select("idx", F.explode(P.zipped()).alias("p")).select("idx", "p.mz", "p.intensity")


def quality_filter(peaks: DataFrame, min_peaks: int = 5, min_range: float = 250.0) -> DataFrame:
    """Spectra with enough peaks over a wide enough range, with both measures."""
    return (peaks.groupBy("idx")
            .agg(F.count("*").alias("n_peaks"), (F.max("mz") - F.min("mz")).alias("mz_range"))
            .filter((F.col("n_peaks") >= min_peaks) & (F.col("mz_range") >= F.lit(float(min_range)))))


def remove_precursor_peaks(peaks: DataFrame, spectra: DataFrame, tol: float = 1.5) -> DataFrame:
    """Peaks away from every charge-reduced precursor line of their spectrum."""
    lines = spectra.select(
        "idx",
        F.when(F.col("precursor_charge") > 0, F.transform(
            F.sequence(F.lit(1), F.greatest(F.col("precursor_charge"), F.lit(1))),
            lambda z: P.precursor_line("precursor_mz", "precursor_charge", z)))
        .otherwise(F.array().cast("array<double>")).alias("_lines"))
    return (peaks.join(lines, "idx")
            .filter(F.forall("_lines", lambda line: F.abs(F.col("mz") - line) > F.lit(tol)))
            .drop("_lines"))


def strongest_peaks(peaks: DataFrame, k: int = 150) -> DataFrame:
    """The k most intense peaks per spectrum; the limit is applied before the shuffle too."""
    w = Window.partitionBy("idx").orderBy(F.desc("intensity"), "mz")
    return peaks.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _strongest_with_max(peaks: DataFrame, k: int) -> DataFrame:
    """:func:`strongest_peaks` with ``peak_max``: the first of the ranking has it, so one sorted pass gives both."""
    w = Window.partitionBy("idx").orderBy(F.desc("intensity"), "mz")
    first = F.first("intensity").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return peaks.withColumns({"rank": F.row_number().over(w), "peak_max": first}).filter(F.col("rank") <= k)


def peak_tokens(peaks: DataFrame, k: int = 150, mz_min: float = 50.0, mz_max: float = 1500.0) -> DataFrame:
    """One row per token: position in m/z order, scaled m/z, scaled intensity."""
    top = _strongest_with_max(peaks, k)
    order = Window.partitionBy("idx").orderBy("mz", "rank")
    return top.select(
        "idx", (F.row_number().over(order) - 1).alias("pos"),
        P.unit_mz("mz", mz_min, mz_max).alias("norm_mz"),
        P.sqrt_scaled(F.col("intensity"), F.col("peak_max")).alias("norm_int"))


def bin_spectra(peaks: DataFrame, k: int = 150, mz_min: float = 50.0, width: float = 0.02,
                n_bins: int = 72_500) -> DataFrame:
    """Sparse binned spectra: per bin the largest scaled intensity."""
    top = _strongest_with_max(peaks, k)
    return (top.select("idx", P.bin_index("mz", mz_min, width).alias("bin"),
                       P.sqrt_scaled(F.col("intensity"), F.col("peak_max")).alias("v"))
            .filter((F.col("bin") >= 0) & (F.col("bin") < n_bins))
            .groupBy("idx", "bin").agg(F.max("v").alias("v")))


def consensus_peaks(members: DataFrame, peaks: DataFrame, mz_min: float = 50.0, width: float = 0.02,
                    n_bins: int = 72_500) -> DataFrame:
    """Consensus spectrum per cluster as rows ``(cluster_id, bin, mz, intensity)``.

    ``members`` has ``(cluster_id, idx, weight)``.  The cluster sums combine map-side right
    after the join.  Weights need no normalising: the factor cancels in both the m/z
    ratio and the scaling to 999.
    """
    top = peaks.groupBy("idx").agg(F.max("intensity").alias("peak_max")).filter(F.col("peak_max") > 0)
    scale = members.join(top, "idx").select(
        "cluster_id", "idx", (F.col("weight") / F.sqrt("peak_max")).alias("scale"))
    placed = (peaks.select("idx", "mz", P.bin_index("mz", mz_min, width).alias("bin"), F.sqrt("intensity").alias("root"))
              .filter((F.col("bin") >= 0) & (F.col("bin") < n_bins)))
    sums = (placed.join(scale, "idx").groupBy("cluster_id", "bin")
            .agg(F.sum(F.col("scale") * F.col("root")).alias("acc"),
                 F.sum(F.col("scale") * F.col("root") * F.col("mz")).alias("acc_mz"))
            .filter(F.col("acc") > 0))
    # a cluster has at most n_bins rows here
    base = F.max("acc").over(Window.partitionBy("cluster_id"))
    return (sums.withColumn("intensity", F.col("acc") / base * F.lit(999.0))
            .filter(F.col("intensity") >= 1.0)
            .select("cluster_id", "bin", (F.col("acc_mz") / F.col("acc")).alias("mz"), "intensity"))


#: Peaks of pairs that a task compares at once.
PEAKS_AT_ONCE = 300_000


def near_peaks(pair: np.ndarray, places: np.ndarray, peaks: np.ndarray, sizes: np.ndarray, tol: float) -> np.ndarray:
    """Whether a place has a peak of its pair within ``tol``; ``peaks`` are the pairs' sorted lists of ``sizes`` in a row.

    Places and peaks are sorted together, so that all pairs are looked up at once.
    """
    ends = np.cumsum(sizes)
    owner = np.concatenate([pair, np.repeat(np.arange(len(sizes)), sizes)])
    is_peak = np.arange(len(owner)) >= len(places)
    order = np.lexsort((is_peak, np.concatenate([places, peaks]), owner))
    below = np.empty(len(owner), np.int64)
    below[order] = np.cumsum(is_peak[order])  # peaks before a place, those of earlier pairs included
    at, low, high = below[:len(places)], (ends - sizes)[pair], ends[pair] - 1
    some = high >= low
    out = np.zeros(len(places), bool)
    at, low, high, places = at[some], low[some], high[some], places[some]
    out[some] = (np.abs(peaks[np.minimum(at, high)] - places) <= tol) | (np.abs(peaks[np.maximum(at - 1, low)] - places) <= tol)
    return out


def fragment_confirmation(pairs: DataFrame, peaks: DataFrame, tol: float = 0.02,
                          min_unshifted: int = 2, min_shifted: int = 1) -> DataFrame:
    """Adds ``unshifted``, ``shifted`` and ``confirmed`` to pairs of spectra.

    ``pairs`` has ``(pair_id, idx_a, idx_b, delta)``.  For every peak of a, a peak of b
    must lie within ``tol`` of it (unshifted), or of it moved by the delta either way
    (shifted).  Only spectra of a pair are looked at; their m/z lists (bounded by the
    spectrum) meet the pairs, and the band test looks the sorted lists up.
    """
    wanted = pairs.select(F.col("idx_a").alias("idx")).union(pairs.select(F.col("idx_b").alias("idx"))).distinct()
    lists = checkpoint(peaks.join(wanted, "idx", "left_semi").groupBy("idx").agg(F.sort_array(F.collect_list(F.col("mz").cast("double"))).alias("_mz")))
    rows = (pairs.join(lists.select(F.col("idx").alias("idx_a"), F.col("_mz").alias("_a")), "idx_a", "left")
            .join(lists.select(F.col("idx").alias("idx_b"), F.col("_mz").alias("_b")), "idx_b", "left"))

    def run(batches):
        for batch in batches:
            shared, moved = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            valid = np.logical_and.reduce([batch.column(n).is_valid().to_numpy(zero_copy_only=False) for n in ("_a", "_b", "delta")])
            sizes = sum(batch.column(n).value_lengths().fill_null(0).to_numpy() for n in ("_a", "_b"))
            rows_in, step = np.flatnonzero(valid), np.cumsum(sizes[valid]) // PEAKS_AT_ONCE
            for at in np.split(rows_in, np.flatnonzero(np.diff(step)) + 1) if len(rows_in) else []:
                part = batch.take(pa.array(at))
                a, b = (part.column(n) for n in ("_a", "_b"))
                pair = np.repeat(np.arange(len(at)), a.value_lengths().to_numpy())
                delta = part.column("delta").to_numpy().astype(np.float64)[pair]
                places, lists = a.flatten().to_numpy(), (b.flatten().to_numpy(), b.value_lengths().to_numpy())
                shared[at] = np.bincount(pair[near_peaks(pair, places, *lists, tol)], minlength=len(at))
                either = near_peaks(pair, places + delta, *lists, tol) | near_peaks(pair, places - delta, *lists, tol)
                moved[at] = np.bincount(pair[either], minlength=len(at))
            kept = [n for n in batch.schema.names if n not in ("_a", "_b")]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(shared), pa.array(moved)],
                                             names=[*kept, "unshifted", "shifted"])

    kinds = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes if n not in ("_a", "_b"))
    hits = rows.mapInArrow(run, f"{kinds}, unshifted long, shifted long").select(*pairs.columns, "unshifted", "shifted")
    return hits.withColumn("confirmed", (F.col("unshifted") >= min_unshifted) & (F.col("shifted") >= min_shifted))
