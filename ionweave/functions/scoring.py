"""Cluster quality, confidence, titles and training schedules."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def quality(mean_similarity, sigma: float = 0.10) -> Column:
    s = _c(mean_similarity)
    return s * F.exp(-(F.lit(1.0) - s) / F.lit(sigma))


def confidence(q, high: float = 0.80, medium: float = 0.50) -> Column:
    return F.when(_c(q) >= high, "HIGH").when(_c(q) >= medium, "MEDIUM").otherwise("LOW")


def member_weight(similarity) -> Column:
    return F.greatest(_c(similarity), F.lit(0.01))


def cluster_title() -> Column:
    """Title of a consensus spectrum, from the cluster-table columns."""
    ptm = F.when(F.col("ptm_flag") & (F.col("ptm_delta_label") != "") & (F.col("n_members") >= 2),
                 F.concat(F.lit("_PTM="), F.col("ptm_delta_label"))).otherwise("")
    het = F.when(F.col("heterogeneous_flag"), "_HET=1").otherwise("")
    return F.concat(
        F.format_string("cluster_%d_n%d_src%d_Q=%.4f_%s", "cluster_id", "n_members",
                        "n_source_files", "quality_score", "confidence"), ptm, het)


def learning_rate(epoch: int, epochs: int, base: float, warmup: int) -> float:
    """Linear warm-up followed by half a cosine."""
    if epoch < warmup:
        return base * (epoch + 1) / warmup
    done = (epoch - warmup) / max(1, epochs - warmup)
    return base * 0.5 * (1.0 + math.cos(math.pi * done))


def uniformity_weight(epoch: int, target: float, warmup: int) -> float:
    return target if warmup <= 0 else target * min(1.0, (epoch + 1) / warmup)


def learning_rate_column(epoch, epochs: int, base: float, warmup: int) -> Column:
    e = _c(epoch)
    done = (e - warmup) / F.lit(float(max(1, epochs - warmup)))
    return F.when(e < warmup, F.lit(base) * (e + 1) / F.lit(float(max(1, warmup)))).otherwise(
        F.lit(base) * 0.5 * (1.0 + F.cos(F.lit(math.pi) * done)))


def uniformity_weight_column(epoch, target: float, warmup: int) -> Column:
    if warmup <= 0:
        return F.lit(float(target))
    return F.lit(target) * F.least(F.lit(1.0), (_c(epoch) + 1) / F.lit(float(warmup)))
