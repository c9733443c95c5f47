"""Stage 3: mass-split, score and flag clusters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionweave.config import ClusterConfig
from ionweave.functions import scoring
from ionweave.functions.mass import MODIFICATION_SHIFTS, MODIFICATION_TOLERANCE, modification_name, neutral_mass
from ionweave.operators.clusters import centroids, member_similarity, precursor_consensus, representatives
from ionweave.operators.mass_groups import mass_groups, numbered_groups
from ionweave.operators.peak_tables import consensus_peaks, fragment_confirmation
from ionweave.session import checkpoint, ordered_index


@dataclass
class Reranked:
    clusters: DataFrame  # one row per cluster
    members: DataFrame  # (cluster_id, idx, similarity, weight, …)
    peaks: DataFrame  # (idx, mz, intensity) the clusters were built from
    cfg: ClusterConfig

    @property
    def consensus(self) -> DataFrame:
        """``(cluster_id, bin, mz, intensity)`` of every cluster."""
        return consensus_peaks(self.members.select("cluster_id", "idx", "weight"), self.peaks,
                               self.cfg.mz_min, self.cfg.bin_width, self.cfg.n_bins)


def modification_table(spark: SparkSession) -> DataFrame:
    """The modification shifts as a 7-row table."""
    return spark.createDataFrame(list(MODIFICATION_SHIFTS.items()), "ptm_name string, delta double")


def modification_lookup(rows: DataFrame, delta: str = "delta") -> DataFrame:
    """Rows with the matching modification name, by a band join with the 7-row table."""
    table = modification_table(rows.sparkSession).withColumnRenamed("delta", "_shift")
    return rows.join(F.broadcast(table), F.abs(F.col(delta) - F.col("_shift")) <= F.lit(MODIFICATION_TOLERANCE),
                     "left").drop("_shift")


def cluster_groups(labelled: DataFrame, cfg: ClusterConfig):
    """Split labelled rows ``(idx, label, mass)`` by mass and give every group a cluster id.

    A label with one group keeps its number; otherwise its groups get fresh numbers after
    the largest label, in label and mass order.  Returns ``(assigned, groups)``.
    """
    grouped = checkpoint(mass_groups(labelled, cfg.precursor_tol_ppm, cfg.mass_group_gap_da))
    numbered = numbered_groups(grouped)
    top = labelled.agg(F.max("label").alias("top")).first()["top"]
    fresh = ordered_index(numbered.filter("n_groups > 1"), "label", "start", "solo", name="nth")
    base = F.lit(0 if top is None else int(top) + 1)
    split = fresh.withColumn("cluster_id", base + F.col("nth")).withColumn("parent_cluster_id", F.col("label")).drop("nth")
    whole = (numbered.filter("n_groups = 1").withColumn("cluster_id", F.col("label"))
             .withColumn("parent_cluster_id", F.lit(-1).cast("bigint")))
    groups = checkpoint(split.unionByName(whole))
    keys = ["label", "start", "solo"]
    assigned = grouped.join(groups.select(*keys, "cluster_id", "parent_cluster_id"), keys)
    return assigned.select("idx", "cluster_id", "parent_cluster_id"), groups


def adjacent_pairs(groups: DataFrame) -> DataFrame:
    """Neighbouring mass groups of a split label whose mass step is a known modification.

    Neighbours are found by their overall position, an equality join.
    """
    split = groups.filter("n_groups > 1")
    a = split.select("label", "pos", F.col("cluster_id").alias("cluster_a"), F.col("start").alias("mass_a"))
    b = split.select("label", (F.col("pos") - 1).alias("pos"), F.col("cluster_id").alias("cluster_b"),
                     F.col("start").alias("mass_b"))
    return (a.join(b, ["label", "pos"]).withColumn("delta", F.abs(F.col("mass_b") - F.col("mass_a")))
            .withColumn("ptm_name", modification_name("delta")).filter("ptm_name <> ''"))


def rerank(labels: DataFrame, spectra: DataFrame, vectors: DataFrame, peaks: DataFrame,
           cfg: ClusterConfig = ClusterConfig()) -> Reranked:
    """Score the clusters of ``labels (idx, label)``.

    ``spectra`` has ``(idx, precursor_mz, precursor_charge, rt, source_file)``, ``vectors``
    ``(idx, embedding)`` for every labelled spectrum, ``peaks`` ``(idx, mz, intensity)``.
    """
    meta = spectra.select("idx", "precursor_mz", "precursor_charge", "rt", "source_file")
    labelled = labels.filter("label >= 0").select("idx", F.col("label").cast("bigint").alias("label")).join(meta, "idx")
    masses = labelled.select("idx", "label", neutral_mass("precursor_mz", "precursor_charge").alias("mass"))
    assigned, groups = cluster_groups(masses, cfg)

    rows = checkpoint(assigned.join(meta, "idx").join(vectors.select("idx", "embedding"), "idx"))
    centers = checkpoint(centroids(rows, ["cluster_id"]))
    scored = member_similarity(rows, centers, ["cluster_id"]).withColumn("weight", scoring.member_weight("similarity"))
    members = checkpoint(scored.drop("embedding"))

    pairs = adjacent_pairs(groups)
    reps = representatives(members, ["cluster_id"])
    spectra_pairs = (pairs.join(reps.select(F.col("cluster_id").alias("cluster_a"), F.col("rep_idx").alias("idx_a")), "cluster_a")
                     .join(reps.select(F.col("cluster_id").alias("cluster_b"), F.col("rep_idx").alias("idx_b")), "cluster_b")
                     .withColumnRenamed("pos", "pair_id"))
    confirmed = checkpoint(
        fragment_confirmation(spectra_pairs, peaks, cfg.ptm_fragment_mz_tol, cfg.ptm_min_unshifted_matches,
                              cfg.ptm_min_shifted_matches)
        .filter("confirmed").select("label", "pair_id", "cluster_a", "cluster_b", "delta", "ptm_name"))
    # a group confirmed on both sides takes the later pair
    flagged = (confirmed.select(F.col("cluster_a").alias("cluster_id"), "pair_id", "delta", "ptm_name")
               .union(confirmed.select("cluster_b", "pair_id", "delta", "ptm_name"))
               .groupBy("cluster_id").agg(F.max_by(F.struct("delta", "ptm_name"), "pair_id").alias("ptm")))
    with_pair = confirmed.select(F.col("label").alias("parent_cluster_id")).distinct().withColumn("_pair", F.lit(True))

    q = scoring.quality("mean_similarity", cfg.sigma_q)
    scores = centers.select(
        "cluster_id", F.round("mean_similarity", 4).alias("mean_similarity"),
        F.round(1.0 - F.col("mean_similarity"), 4).alias("within_var"), F.round(q, 4).alias("quality_score"),
        scoring.confidence(q, cfg.high_q_threshold, cfg.medium_q_threshold).alias("confidence"), "centroid")
    clusters = (groups.select("cluster_id", "parent_cluster_id", "label", "pos", "grp")
                .join(scores, "cluster_id")
                .join(precursor_consensus(members, ["cluster_id"]), "cluster_id")
                .join(flagged, "cluster_id", "left")
                .join(with_pair, "parent_cluster_id", "left")
                .withColumn("ptm_flag", F.col("ptm").isNotNull())
                .withColumn("ptm_delta_label", F.coalesce("ptm.ptm_name", F.lit("")))
                .withColumn("ptm_delta_mass", F.coalesce(F.round("ptm.delta", 4), F.lit(0.0)))
                .withColumn("heterogeneous_flag", (F.col("parent_cluster_id") >= 0) & F.col("_pair").isNull())
                .drop("ptm", "_pair"))
    return Reranked(checkpoint(clusters), members, peaks, cfg)


def output_order():
    """Best quality first; equal scores in the order the clusters were built."""
    return [F.desc("quality_score"), F.asc("pos")]


def run_summary(clusters: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts of a run as one row."""
    totals = labels.agg(F.count("*").alias("n_total"), F.count_if(F.col("label") < 0).alias("n_noise"))
    counts = clusters.agg(
        F.count("*").alias("n_clusters"),
        F.count_if(F.col("confidence") == "HIGH").alias("n_high"),
        F.count_if(F.col("confidence") == "MEDIUM").alias("n_medium"),
        F.count_if(F.col("confidence") == "LOW").alias("n_low"),
        F.count_if(F.col("ptm_flag") & (F.col("n_members") >= 2)).alias("n_ptm"),
        F.count_if("heterogeneous_flag").alias("n_heterogeneous"),
        F.count_if(F.col("parent_cluster_id") >= 0).alias("n_split"),
        F.count_if(F.col("n_source_files") > 1).alias("n_cross_file"),
        F.coalesce(F.avg("n_members"), F.lit(0.0)).alias("avg_size"),
        F.coalesce(F.max("n_members"), F.lit(0)).alias("max_size"))
    one = F.lit(1)  # both sides have a single row
    return totals.withColumn("_k", one).join(counts.withColumn("_k", one), "_k").drop("_k")
