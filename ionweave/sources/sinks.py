"""Result files.  Everything that grows with the data is written by Spark in parts."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionweave.config import ClusterConfig
from ionweave.functions.scoring import cluster_title
from ionweave.operators.rerank import Reranked, output_order
from ionweave.session import checkpoint
from ionweave.sources.store import write_bytes

# Fixed column order of the result tables.
CLUSTER_COLUMNS = ["cluster_id", "parent_cluster_id", "scan_id", "source_file", "precursor_mz", "precursor_charge",
                   "quality_score", "confidence", "ptm_flag", "ptm_delta_label", "ptm_delta_mass",
                   "heterogeneous_flag", "n_source_files", "within_var", "mean_similarity"]
NOISE_COLUMNS = ["scan_id", "source_file", "precursor_mz", "precursor_charge"]


def _decimals(col: str):
    """Four decimals; representation noise is removed first, so exact halves round up."""
    return F.format_string("%.4f", F.round(col, 8))


def _short(col: str):
    """A value of at most four decimals without trailing zeros, but with one decimal at least."""
    return F.regexp_replace(_decimals(col), r"(\.\d+?)0+$", "$1")


def _flag(col: str):
    return F.when(F.col(col), "True").otherwise("False")


def cluster_rows(result: Reranked, spectra: DataFrame) -> DataFrame:
    """One text row per cluster member, with its sort keys ``quality``, ``pos`` and ``idx``."""
    members = result.members.select("cluster_id", "idx").join(
        spectra.select("idx", "scan_id", "source_file", "precursor_mz", "precursor_charge"), "idx")
    # texts of a cluster are made once, before its members come in
    clusters = result.clusters.select(
        F.col("quality_score").alias("quality"), "pos", "cluster_id", "parent_cluster_id",
        _short("quality_score").alias("quality_score"), "confidence", _flag("ptm_flag").alias("ptm_flag"),
        "ptm_delta_label", _decimals("ptm_delta_mass").alias("ptm_delta_mass"),
        _flag("heterogeneous_flag").alias("heterogeneous_flag"), "n_source_files",
        _decimals("within_var").alias("within_var"),
        _decimals("mean_similarity").alias("mean_similarity"))
    rows = members.withColumn("precursor_mz", _decimals("precursor_mz")).join(clusters, "cluster_id")
    return rows.select("quality", "pos", "idx", *CLUSTER_COLUMNS)


def noise_rows(labels: DataFrame, spectra: DataFrame) -> DataFrame:
    """Unclustered spectra with ``idx`` as sort key."""
    return (labels.filter("label = -1").select("idx").join(spectra, "idx")
            .select("idx", "scan_id", "source_file", _decimals("precursor_mz").alias("precursor_mz"),
                    "precursor_charge"))


def consensus_blocks(result: Reranked) -> DataFrame:
    """Ion blocks ``(cluster_id, quality_score, pos, block)`` of the confident clusters.

    A consensus has at most one peak per bin, which bounds the length of a block.
    """
    line = F.struct("bin", F.format_string("%.4f %.1f", "mz", "intensity").alias("line"))
    lists = result.consensus.groupBy("cluster_id").agg(F.sort_array(F.collect_list(line)).alias("_peaks"))
    good = result.clusters.filter(F.col("confidence").isin("HIGH", "MEDIUM"))
    block = F.concat_ws(
        "\n", F.lit("BEGIN IONS"), F.concat(F.lit("TITLE="), cluster_title()),
        F.concat(F.lit("SCANS="), F.col("cluster_id").cast("string")),
        F.when(F.col("consensus_rt") > 0, F.format_string("RTINSECONDS=%.3f", "consensus_rt")),
        F.format_string("PEPMASS=%.6f", "consensus_precursor_mz"),
        F.when(F.col("consensus_precursor_charge") > 0, F.format_string("CHARGE=%d+", "consensus_precursor_charge")),
        F.array_join(F.transform("_peaks", lambda p: p["line"]), "\n"), F.lit("END IONS"))
    ascii_only = F.regexp_replace(block, r"[^\x00-\x7F]", "?")
    return good.join(lists, "cluster_id").select("cluster_id", "quality_score", "pos", ascii_only.alias("block"))


def spectrum_blocks(spectra: DataFrame) -> DataFrame:
    """Spectrum rows as MGF blocks, the inverse of the reader."""
    line = F.zip_with("mz", "intensity", lambda m, i: F.concat_ws(" ", m.cast("string"), i.cast("string")))
    block = F.concat_ws(
        "\n", F.lit("BEGIN IONS"), F.concat(F.lit("TITLE="), F.col("scan_id")),
        F.concat(F.lit("PEPMASS="), F.col("precursor_mz").cast("string")),
        F.when(F.col("precursor_charge") > 0, F.concat(F.lit("CHARGE="), F.col("precursor_charge").cast("string"), F.lit("+"))),
        F.concat(F.lit("RTINSECONDS="), F.col("rt").cast("string")),
        F.array_join(line, "\n"), F.lit("END IONS"))
    return spectra.select("idx", block.alias("block"))


def _tsv(df: DataFrame, columns, order, path: str) -> None:
    # a total order by range; every part carries the header
    df.orderBy(*order).select(*columns).write.mode("overwrite").csv(path, sep="\t", header=True, quote="")


def write_clusters(result: Reranked, spectra: DataFrame, folder: str) -> None:
    _tsv(cluster_rows(result, spectra), CLUSTER_COLUMNS, [F.desc("quality"), "pos", "idx"], f"{folder}/clusters.tsv")


def write_noise(labels: DataFrame, spectra: DataFrame, folder: str) -> None:
    _tsv(noise_rows(labels, spectra), NOISE_COLUMNS, ["idx"], f"{folder}/noise_spectra.tsv")


def write_consensus(result: Reranked, folder: str) -> int:
    """Write the consensus file in parts and return the number of spectra."""
    blocks = checkpoint(consensus_blocks(result))
    blocks.orderBy(*output_order()).select(F.concat("block", F.lit("\n")).alias("value")).write.mode("overwrite").text(
        f"{folder}/consensus_spectra.mgf")
    return blocks.count()


def encoder_label(cfg: ClusterConfig) -> str:
    if not cfg.use_encoder:
        return "raw bins for hashing, no encoder"
    if cfg.encoder_weights:
        return f"transformer [pretrained: {cfg.encoder_weights}]"
    return "transformer [random weights]" if cfg.use_transformer else "binned projection"


def summary_text(row, elapsed: float, cfg: ClusterConfig) -> str:
    clustered = row["n_total"] - row["n_noise"]
    share = 100.0 * clustered / max(row["n_total"], 1)
    lines = [
        ("Stage-1 encoder", encoder_label(cfg)), ("Input spectra", f"{row['n_total']:,}"),
        ("Clustered", f"{clustered:,}  ({share:.1f}%)"), ("Noise / unclustered", f"{row['n_noise']:,}"),
        ("Total clusters", f"{row['n_clusters']:,}"), ("HIGH confidence", f"{row['n_high']:,}"),
        ("MEDIUM confidence", f"{row['n_medium']:,}"), ("LOW confidence", f"{row['n_low']:,}"),
        ("PTM-flagged", f"{row['n_ptm']:,}"), ("Heterogeneous-split", f"{row['n_heterogeneous']:,}"),
        ("From mass-split parents", f"{row['n_split']:,}"), ("Cross-experiment", f"{row['n_cross_file']:,}"),
        ("Avg cluster size", f"{row['avg_size']:.1f}"), ("Max cluster size", f"{row['max_size']:,}"),
        ("Wall time (s)", f"{elapsed:.1f}")]
    return "\n".join(f"{name:<24}: {value:>12}" for name, value in lines) + "\n"


def write_text(spark: SparkSession, path: str, text: str) -> None:
    write_bytes(spark, path, text.encode("utf-8"))


def write_summary(spark: SparkSession, summary: DataFrame, folder: str, elapsed: float, cfg: ClusterConfig) -> str:
    text = summary_text(summary.first(), elapsed, cfg)
    write_text(spark, f"{folder}/summary.txt", text)
    write_text(spark, f"{folder}/config.txt", "".join(f"{k:<35} = {v}\n" for k, v in asdict(cfg).items()))
    return text
