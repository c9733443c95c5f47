"""Splitting loose clusters and merging close ones.

Labels are named by their smallest member id throughout, so a relabelling never needs a
global counter; :func:`dense_labels` renumbers them at the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionweave.config import ClusterConfig
from ionweave.operators.clusters import centroids
from ionweave.operators.density import density_clusters
from ionweave.operators.graph import connected_components
from ionweave.operators.tiles import TILE_ROWS, reach_links
from ionweave.session import ordered_index


def dynamic_split(rows: DataFrame, cfg: ClusterConfig, eps: float = None, var_threshold: float = None,
                  tile_rows: int = TILE_ROWS) -> DataFrame:
    """Re-cluster loose clusters of rows ``(idx, label, embedding)``; returns ``(idx, label)``.

    A cluster of 4 or more members whose variance is above the limit is clustered by
    density on its own, whatever its size.
    """
    eps = cfg.dbscan_eps if eps is None else eps
    var_threshold = cfg.split_var_threshold if var_threshold is None else var_threshold
    loose = (centroids(rows.filter("label >= 0"), ["label"])
             .filter((F.col("n") >= 4) & (F.col("variance") > var_threshold))
             .select("label"))
    again = density_clusters(rows.join(loose, "label", "left_semi").select("idx", "label", "embedding")
                             .withColumnRenamed("label", "parent"),
                             eps, cfg.dbscan_min_samples, ["parent"], tile_rows)
    kept = rows.join(loose, "label", "left_anti").select("idx", "label")
    return kept.unionByName(again.select("idx", "label"))


def dynamic_merge(rows: DataFrame, cfg: ClusterConfig, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Merge clusters whose centroids are closer than the threshold, transitively.

    The smallest label of a merged set survives.
    """
    centers = centroids(rows.filter("label >= 0"), ["label"]).select(
        F.col("label").alias("idx"), F.col("centroid").alias("embedding"))
    members, links = reach_links(centers, cfg.merge_dist_threshold, (), 1, True, tile_rows)
    # equal centroids share a vid without needing a link, unless both are zero
    real = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x) > 0
    same = members.filter("idx <> vid").join(centers.filter(real), "idx", "left_semi")
    links = links.unionByName(same.select(F.col("idx").alias("src"), F.col("vid").alias("dst")))
    parts = connected_components(links)
    merged = rows.join(parts, rows["label"] == parts["node"], "left")
    return merged.select("idx", F.coalesce("component", "label").alias("label"))


def dense_labels(labels: DataFrame) -> DataFrame:
    """Renumber the labels of ``(idx, label)`` to 0, 1, … in ascending order; noise stays -1."""
    names = labels.filter("label >= 0").select("label").distinct()
    numbers = ordered_index(names, "label", name="number")
    return labels.join(numbers, "label", "left").select(
        "idx", F.coalesce("number", F.lit(-1).cast("bigint")).alias("label"))


def canonical_labels(labels: DataFrame) -> DataFrame:
    """Rename every cluster of ``(idx, label)`` to its smallest member id."""
    names = labels.filter("label >= 0").groupBy("label").agg(F.min("idx").alias("name"))
    return labels.join(names, "label", "left").select(
        "idx", F.coalesce("name", F.lit(-1).cast("bigint")).alias("label"))


def label_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Cluster and noise counts before and after a refinement step, as one row."""
    def counts(df, name):
        return df.agg(F.countDistinct(F.when(F.col("label") >= 0, F.col("label"))).alias(f"clusters_{name}"),
                      F.count_if(F.col("label") < 0).alias(f"noise_{name}"))
    one = F.lit(1)  # both sides have a single row
    return (counts(before, "before").withColumn("_k", one)
            .join(counts(after, "after").withColumn("_k", one), "_k").drop("_k"))
