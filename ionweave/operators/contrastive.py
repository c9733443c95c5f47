"""Training measures and augmentation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ionweave.functions import peaks as P
from ionweave.operators.classes import mixed
from ionweave.operators.tiles import matrix


def separation(rows: DataFrame) -> DataFrame:
    """Mean similarity inside classes, between classes, and their difference, as one row.

    ``rows`` has ``(label, embedding)``.  The sum over the pairs of a set of vectors is
    (|sum|^2 - sum of |x|^2) / 2, so per-class sums replace the pairs.  Inside is the mean
    over classes with at least two rows, between the mean over all pairs of two classes.
    """
    some = rows.select(F.size("embedding").alias("dim")).first()
    places = [f"_s{p}" for p in range(some["dim"] if some else 0)]
    squares = F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda acc, x: acc + x * x)
    sums = rows.withColumn("_sq", squares).groupBy("label").agg(
        F.count("*").cast("double").alias("n"), F.sum("_sq").alias("sq"),
        *[F.sum(F.col("embedding")[p].cast("double")).alias(name) for p, name in enumerate(places)])

    def length(names):
        return F.aggregate(F.array(*names).cast("array<double>"), F.lit(0.0), lambda acc, x: acc + x * x)

    per_class = sums.withColumn("inside", length(places) - F.col("sq")).withColumn("pairs", F.col("n") * (F.col("n") - 1))
    inside = per_class.agg(F.coalesce(F.avg(F.when(F.col("n") >= 2, F.col("inside") / F.col("pairs"))), F.lit(0.0)).alias("intra"),
                           F.sum("inside").alias("in_sum"), F.sum("pairs").alias("in_pairs"), F.sum("n").alias("total"))
    whole = sums.agg(F.sum("sq").alias("sq"), *[F.sum(name).alias(name) for name in places]).select(
        (length(places) - F.col("sq")).alias("all_sum"))
    pairs = F.col("total") * (F.col("total") - 1) - F.col("in_pairs")
    one = F.lit(1)  # both sides have a single row
    out = inside.withColumn("_k", one).join(whole.withColumn("_k", one), "_k").select(
        "intra", F.when(pairs > 0, (F.col("all_sum") - F.col("in_sum")) / pairs).otherwise(0.0).alias("inter"))
    return out.withColumn("separation", F.col("intra") - F.col("inter"))


def contrastive_loss(vec: np.ndarray, label: np.ndarray, temperature: float):
    """(supervised contrastive term, uniformity term) of one batch, and has-positives."""
    n = len(vec)
    cos = vec @ vec.T
    same = label[:, None] == label[None, :]
    off = ~np.eye(n, dtype=bool)
    positive = same & off
    anchors = positive.any(1)
    if not anchors.any():
        return 0.0, 0.0, False
    logits = np.where(off, cos / temperature, -np.inf)
    top = logits.max(1, keepdims=True)
    log_sum = top + np.log(np.exp(logits - top).sum(1, keepdims=True))
    log_prob = np.where(positive, cos / temperature - log_sum, 0.0)
    loss = -(log_prob.sum(1)[anchors] / positive.sum(1)[anchors]).mean()
    negative = ~same
    spread = float(np.log(np.exp(-2.0 * (2.0 - 2.0 * cos[negative])).mean() + 1e-8)) if negative.any() else 0.0
    return float(loss), spread, True


def batch_losses(batches: DataFrame, temperature: float = 0.10, uniformity: float = 0.15) -> DataFrame:
    """``(batch, n, supcon, uniform, loss)`` of rows ``(batch, label_idx, embedding)``.

    A batch has P x K rows, whatever the size of the data.
    """

    def kernel(table: pa.Table) -> pa.Table:
        loss, spread, usable = contrastive_loss(matrix(table.column("embedding")),
                                                table.column("label_idx").to_numpy(), temperature)
        return pa.table({"batch": [table.column("batch")[0].as_py()], "n": [table.num_rows], "supcon": [loss],
                         "uniform": [spread], "loss": [loss + uniformity * spread if usable else 0.0]})

    return batches.select("batch", "label_idx", "embedding").groupBy("batch").applyInArrow(
        kernel, "batch long, n long, supcon double, uniform double, loss double")


def epoch_means(losses: DataFrame) -> DataFrame:
    return losses.agg(F.avg("loss").alias("loss"), F.avg("supcon").alias("supcon"), F.avg("uniform").alias("uniform"))


def _uniform(seed: int, salt: int, *keys: Column) -> Column:
    """Seeded value in (0, 1) by integer arithmetic, the same in every engine and partitioning."""
    return (mixed(*keys, F.lit(seed), F.lit(salt)) + 0.5) / F.lit(2147483647.0)


def _normal(seed: int, salt: int, *keys: Column) -> Column:
    radius = F.sqrt(-2.0 * F.log(_uniform(seed, salt, *keys)))
    return radius * F.cos(2.0 * np.pi * _uniform(seed, salt + 1, *keys))


def _changed(mz, intensity, place, top, key, noise, jitter, mz_min, mz_max, seed) -> Column:
    if noise > 0:
        intensity = F.greatest(intensity + _normal(seed, 2, key, place) * noise * top, F.lit(0.0))
    if jitter > 0:
        mz = F.least(F.greatest(mz + _normal(seed, 4, key, place) * jitter * (mz_max - mz_min), F.lit(mz_min)), F.lit(mz_max))
    return F.struct(mz.alias("mz"), intensity.alias("intensity"))


def augmented(peaks: Column, key: Column, drop: float = 0.15, noise: float = 0.08, jitter: float = 0.01,
              mz_min: float = 50.0, mz_max: float = 1500.0, seed: int = 42) -> Column:
    """Peaks with random loss, intensity noise and m/z jitter, seeded by ``key`` and position.

    Never drops every peak.  The jitter is relative to the m/z range, not in dalton.
    """
    # an expression that lambdas mention is worked out at every mention; as the element of an array it is worked out once
    def once(value: Column, body) -> Column:
        return F.transform(F.array(value), body)[0]

    def change(p, top):
        return _changed(p["mz"], p["intensity"], p["i"], top, key, noise, jitter, mz_min, mz_max, seed)

    def changed(kept):
        return once(F.array_max(F.transform(kept, lambda p: p["intensity"])),
                    lambda top: F.transform(kept, lambda p: change(p, top)))

    placed = F.transform(peaks, lambda p, i: F.struct(p["mz"].alias("mz"), p["intensity"].alias("intensity"), i.alias("i")))
    if drop <= 0:
        return once(placed, changed)
    return once(placed, lambda all_: once(
        F.filter(all_, lambda p: _uniform(seed, 1, key, p["i"]) > drop),
        lambda some: once(F.when(F.size(some) > 0, some).otherwise(all_), changed)))


def augmented_peaks(peaks: DataFrame, drop: float = 0.15, noise: float = 0.08, jitter: float = 0.01, mz_min: float = 50.0,
                    mz_max: float = 1500.0, seed: int = 42) -> DataFrame:
    """:func:`augmented` for a long table ``(idx, i, mz, intensity)``, as ``(idx, pos, mz, intensity)``.

    ``i`` is the place of a peak in its spectrum, which seeds the draws.  These are compiled expressions over rows, one
    shuffle in all, and no spectrum has to be one row.
    """
    whole = Window.partitionBy("idx")
    judged = peaks.withColumn("_stays", _uniform(seed, 1, F.col("idx"), F.col("i")) > drop if drop > 0 else F.lit(True))
    kept = judged.withColumn("_any", F.max("_stays").over(whole)).filter("_stays or not _any")
    kept = kept.withColumn("_top", F.max("intensity").over(whole)).withColumn(
        "pos", (F.row_number().over(whole.orderBy("i")) - 1).cast("int"))
    new = _changed(F.col("mz"), F.col("intensity"), F.col("i"), F.col("_top"), F.col("idx"), noise, jitter, mz_min, mz_max, seed)
    return kept.select("idx", "pos", new.alias("_p")).select("idx", "pos", "_p.mz", "_p.intensity")


def training_tokens(samples: DataFrame, cfg, augment: bool, epoch: int = 0) -> DataFrame:
    """Samples with their token column, augmented when asked."""
    peaks = P.zipped()
    if cfg.remove_precursor_peaks:
        peaks = P.without_precursor(peaks, tol=cfg.precursor_removal_tol_da)
    if augment and cfg.augment:
        peaks = augmented(peaks, F.col("idx"), cfg.aug_peak_drop_prob, cfg.aug_intensity_noise, cfg.aug_mz_jitter,
                          cfg.mz_min, cfg.mz_max, cfg.seed + epoch)
    return samples.withColumn("tokens", P.tokens(peaks, cfg.top_k_peaks, cfg.mz_min, cfg.mz_max))
