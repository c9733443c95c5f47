"""Per-cluster vector measures.

For unit-direction centroids the mean similarity of the members is the length of their
mean vector, so mean similarity, variance and quality need one aggregation and no join
back to the members.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionweave.functions import scoring
from ionweave.functions.vectors import dot, norm, unit
from ionweave.operators.tiles import COSINE_DIGITS


def mean_vectors(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Member count and mean vector per key: one sum per dimension, combined map-side, and one row per key."""
    some = rows.select(F.size("embedding").alias("dim")).first()
    sums = rows.groupBy(*keys).agg(F.count("*").alias("n"), *[
        F.avg(F.col("embedding")[p].cast("double")).alias(f"_m{p}") for p in range(some["dim"] if some else 0)])
    mean = [c for c in sums.columns if c.startswith("_m")]
    return sums.select(*keys, "n", F.array(*mean).cast("array<double>").alias("mean"))


def centroids(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(*keys, n, centroid, mean_similarity, variance)``.

    Mean similarity is over unit members; a group below two members, or with a zero
    mean, has variance 0.
    """
    means = mean_vectors(rows, keys).withColumn("_len", norm("mean"))
    return means.select(
        *keys, "n", unit("mean").alias("centroid"), F.col("_len").alias("mean_similarity"),
        F.when((F.col("n") < 2) | (F.col("_len") == 0), F.lit(0.0)).otherwise(1.0 - F.col("_len")).alias("variance"))


def cluster_quality(rows: DataFrame, keys: Sequence[str], sigma: float = 0.10,
                    high: float = 0.80, medium: float = 0.50) -> DataFrame:
    """Mean similarity, variance, quality score and confidence; scores rounded to 4 digits."""
    q = scoring.quality("mean_similarity", sigma)
    return centroids(rows, keys).select(
        *keys, "n", F.round("mean_similarity", 4).alias("mean_similarity"),
        F.round(1.0 - F.col("mean_similarity"), 4).alias("within_var"),
        F.round(q, 4).alias("quality_score"), scoring.confidence(q, high, medium).alias("confidence"))


def member_similarity(rows: DataFrame, centers: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Members with their similarity to the centroid of their group."""
    return (rows.join(centers.select(*keys, "centroid"), list(keys))
            .withColumn("similarity", dot("embedding", "centroid")).drop("centroid"))


def representatives(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Member closest to its centroid; ties go to the smallest id."""
    order = F.struct(F.round("similarity", COSINE_DIGITS), -F.col("idx"))
    return scored.groupBy(*keys).agg(F.max_by("idx", order).alias("rep_idx"))


def modal_charges(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Most frequent known charge, the earliest seen on a tie, 0 where none is known."""
    counts = (rows.groupBy(*keys, "precursor_charge")
              .agg(F.count("*").alias("_n"), F.min("idx").alias("_first")))
    known = F.when(F.col("precursor_charge") > 0, F.struct(F.col("_n"), -F.col("_first")))
    return counts.groupBy(*keys).agg(
        F.coalesce(F.max_by(F.when(F.col("precursor_charge") > 0, F.col("precursor_charge")), known), F.lit(0))
        .alias("consensus_precursor_charge"))


def precursor_consensus(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Consensus precursor per group of weighted members.

    ``rows`` has ``(*keys, idx, precursor_mz, precursor_charge, rt, source_file, weight)``.
    """
    totals = rows.groupBy(*keys).agg(
        F.count("*").alias("n_members"),
        # representation noise goes first, so that exact halves round up
        F.round(F.round(F.sum(F.col("weight") * F.col("precursor_mz")) / F.sum("weight"), 9), 6)
        .alias("consensus_precursor_mz"),
        F.round(F.avg("rt"), 3).alias("consensus_rt"))
    files = rows.groupBy(*keys).agg(F.countDistinct("source_file").alias("n_source_files"))
    return totals.join(files, list(keys)).join(modal_charges(rows, keys), list(keys))
