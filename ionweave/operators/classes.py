"""Training classes: matched spectra, class table, split and batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionweave.config import PretrainConfig
from ionweave.functions.text import base_peptide, class_label
from ionweave.session import checkpoint, ordered_index


def match_psms(psm: DataFrame, spectra: DataFrame) -> DataFrame:
    """Matches joined with their spectrum on the scan number."""
    return psm.join(spectra, "scan_id")


def unmatched_psms(psm: DataFrame, spectra: DataFrame) -> DataFrame:
    return psm.join(spectra.select("scan_id"), "scan_id", "left_anti")


def match_counts(psm: DataFrame, spectra: DataFrame) -> DataFrame:
    """Matched and unmatched rows, and whether most are unmatched, as one row."""
    keys = spectra.select("scan_id").distinct().withColumn("_hit", F.lit(1))
    return psm.join(keys, "scan_id", "left").agg(
        F.count("_hit").alias("matched"), F.count_if(F.col("_hit").isNull()).alias("unmatched")).withColumn(
        "mostly_unmatched", F.col("unmatched") > F.col("matched"))


def seeded_order(key, seed: int):
    """Integer-hash order of a text key, the same in every engine that has md5."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key if not isinstance(key, str) else F.col(key)))


def build_classes(matched: DataFrame, min_size: int = 3, max_classes: int = None, seed: int = 42) -> DataFrame:
    """Samples ``(scan_id, label, label_idx, class_size)`` of the large enough classes.

    ``matched`` has ``(scan_id, peptide, precursor_charge)``.  Class numbers follow the
    sorted names.
    """
    rows = matched.select("scan_id", class_label("peptide", "precursor_charge").alias("label"))
    sizes = rows.groupBy("label").agg(F.count("*").alias("class_size")).filter(F.col("class_size") >= min_size)
    if max_classes:
        picked = ordered_index(sizes.withColumn("_key", seeded_order("label", seed)), "_key", "label", name="_n")
        sizes = picked.filter(F.col("_n") < max_classes).drop("_n", "_key")
    numbered = ordered_index(sizes, "label", name="label_idx")
    return rows.join(numbered, "label").select("scan_id", "label", "label_idx", "class_size")


def class_weights(samples: DataFrame) -> DataFrame:
    """Inverse class size per sample."""
    sizes = samples.groupBy("label").agg(F.count("*").alias("_n"))
    return samples.select("scan_id", "label").join(sizes, "label").select(
        "scan_id", "label", (F.lit(1.0) / F.greatest("_n", F.lit(1))).alias("weight"))


def split_peptides(labels: DataFrame, share: float = 0.15, seed: int = 42) -> DataFrame:
    """``(peptide, is_val)``: charge variants of a peptide stay on one side."""
    peptides = labels.select(base_peptide("label").alias("peptide")).distinct()
    ordered = ordered_index(peptides.withColumn("_key", seeded_order("peptide", seed)), "_key", "peptide", name="_n")
    n_val = max(1, int(ordered.count() * share))
    return ordered.select("peptide", (F.col("_n") < n_val).alias("is_val"))


def split_psms(psm: DataFrame, split: DataFrame):
    """Training and validation matches; matches of dropped peptides are in neither."""
    train = psm.join(split.filter("NOT is_val"), "peptide", "left_semi")
    return train, psm.join(split.filter("is_val"), "peptide", "left_semi")


def mixed(*parts):
    """Seeded non-negative integer from integer columns, by plain arithmetic.

    Products stay below 2^63, so every SQL engine gets the same numbers.
    """
    h = F.lit(17).cast("bigint")
    for p in parts:
        h = (h * F.lit(48271) + p * F.lit(69621) + F.lit(11)) % F.lit(2147483647)
        h = (h * (h % F.lit(65537) + F.lit(3))) % F.lit(2147483647)
    return h


def pk_batches(samples: DataFrame, classes_per_batch: int = 64, samples_per_class: int = 8, seed: int = 42,
               epoch: int = 0) -> DataFrame:
    """Batches ``(batch, slot, draw, label_idx, sample)`` of P classes with K samples each.

    ``samples`` has ``(label_idx, sample)``.  An epoch goes through the classes in rounds: each round has a hash order
    of its own, and a batch is the next P classes of it, so classes of a batch differ and any set can meet.  The samples
    of a class have one hash order per epoch; round r takes the r-th K of them, from the start again at the end, so
    samples differ unless the class has fewer than K.
    """
    keyed = samples.select("label_idx", "sample").withColumn("_key", mixed(F.lit(seed), F.lit(epoch), F.col("sample")))
    placed = ordered_index(keyed, "label_idx", "_key", "sample", name="at")
    classes = checkpoint(placed.groupBy("label_idx").agg(F.min("at").alias("first"), F.count("*").alias("size")))
    total = classes.agg(F.count("*").alias("classes"), F.sum("size").alias("n")).first()
    n_classes, n, k = total["classes"], total["n"] or 0, samples_per_class
    p = max(1, min(classes_per_batch, n_classes))
    n_batches, per_round = max(1, n // (p * k)), max(1, n_classes // p)
    rounds = classes.withColumn("round", F.explode(F.expr(f"sequence(0L, {(n_batches - 1) // per_round}L)")))
    rounds = rounds.withColumn("_key", mixed(F.lit(seed + 1), F.lit(epoch), F.col("round"), F.col("label_idx")))
    slots = ordered_index(rounds, "round", "_key", "label_idx", name="_place").withColumn(
        "_place", F.col("_place") - F.col("round") * n_classes).filter(F.col("_place") < per_round * p)
    slots = slots.select((F.col("round") * per_round + F.floor(F.col("_place") / p)).alias("batch"),
                         (F.col("_place") % p).cast("int").alias("slot"), "round", "first", "size").filter(F.col("batch") < n_batches)
    draws = slots.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    at = F.col("first") + (F.col("round") * k + F.col("draw")) % F.col("size")
    return draws.select("batch", "slot", "draw", at.alias("at")).join(placed, "at").select(
        "batch", "slot", "draw", "label_idx", "sample")


def training_samples(psm: DataFrame, spectra: DataFrame, cfg: PretrainConfig) -> DataFrame:
    """Samples with their spectrum: join, quality filter, classes."""
    from ionweave.functions import peaks as P
    matched = match_psms(psm, spectra)
    if cfg.quality_filter_enabled:
        matched = matched.filter(P.passes_quality("mz", cfg.quality_min_peaks, cfg.quality_min_mz_range))
    classes = build_classes(matched, cfg.min_spectra_per_peptide, cfg.max_peptides, cfg.seed)
    return classes.join(spectra, "scan_id")
