"""Data side of encoder training: samples, splits, batches, and the measures of an encoder.

Fitting the weights is left to a trainer that reads the batches; its encoder comes back as a parameter file.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionweave.config import PretrainConfig
from ionweave.functions.scoring import learning_rate, uniformity_weight
from ionweave.operators.classes import match_counts, pk_batches, split_peptides, split_psms, training_samples
from ionweave.operators.contrastive import separation, training_tokens
from ionweave.operators.encode import checked_parameters, encode_tokens
from ionweave.session import checkpoint
from ionweave.sources.mgf import read_mgf, training_spectra
from ionweave.sources.psm import read_psm

log = logging.getLogger("ionweave")


@dataclass
class TrainingData:
    train: DataFrame
    validation: DataFrame


@dataclass
class Patience:
    """Keeps the best value and says when to stop."""

    limit: int
    best: float = -1e9
    best_epoch: int = 0
    waited: int = 0

    def better(self, epoch: int, value: float) -> bool:
        if value > self.best:
            self.best, self.best_epoch, self.waited = value, epoch, 0
            return True
        self.waited += 1
        return False

    @property
    def exhausted(self) -> bool:
        return self.waited >= self.limit


def prepare(spectra: DataFrame, psm: DataFrame, cfg: PretrainConfig) -> TrainingData:
    """Classes over all matches, split by peptide, then classes again on each side."""
    counts = match_counts(psm, spectra).first()
    if counts["mostly_unmatched"]:
        log.warning("%d of %d matches have no spectrum: check that scan numbers agree", counts["unmatched"], counts["matched"] + counts["unmatched"])
    full = training_samples(psm, spectra, cfg)
    train, validation = split_psms(psm, split_peptides(full.select("label"), cfg.val_split, cfg.seed))
    return TrainingData(checkpoint(training_samples(train, spectra, cfg)),
                        checkpoint(training_samples(validation, spectra, cfg)))


def load(spark: SparkSession, cfg: PretrainConfig) -> TrainingData:
    spectra = checkpoint(training_spectra(read_mgf(spark, cfg.mgf_path)))
    return prepare(spectra, read_psm(spark, cfg.psm_path, cfg.psm_format, cfg.fdr_threshold), cfg)


def epoch_batches(data: DataFrame, cfg: PretrainConfig, epoch: int) -> DataFrame:
    """``(batch, slot, draw, label_idx, tokens)`` of one epoch, augmented."""
    batches = pk_batches(data.select("label_idx", F.col("idx").alias("sample")), cfg.pk_classes_per_batch,
                         cfg.pk_samples_per_class, cfg.seed, epoch)
    rows = batches.join(data.select(F.col("idx").alias("sample"), "idx", "mz", "intensity", "precursor_mz",
                                    "precursor_charge"), "sample")
    return training_tokens(rows, cfg, True, epoch).select("batch", "slot", "draw", "label_idx", "tokens")


def validate(data: DataFrame, cfg: PretrainConfig, parameters: dict) -> dict:
    tokens = training_tokens(data, cfg, False).select("idx", "tokens")
    vectors = encode_tokens(tokens, cfg, checked_parameters(parameters, cfg))
    row = separation(vectors.join(data.select("idx", F.col("label_idx").alias("label")), "idx")).first()
    return row.asDict()


def write_batches(data: TrainingData, cfg: PretrainConfig, epochs: int = None) -> list[str]:
    """Write the token batches of every epoch as tables for a trainer; returns their paths.

    A batch has P x K rows; its rows lie together, so a trainer reads batch after batch.  ``learning_rate`` and
    ``uniformity`` are the epoch's settings.
    """
    paths = []
    for epoch in range(cfg.epochs if epochs is None else epochs):
        lr = learning_rate(epoch, cfg.epochs, cfg.lr, cfg.warmup_epochs)
        weight = uniformity_weight(epoch, cfg.lambda_uniform, cfg.lambda_uniform_warmup_epochs)
        rows = epoch_batches(data.train, cfg, epoch).withColumn("learning_rate", F.lit(lr)).withColumn("uniformity", F.lit(weight))
        paths.append(f"{cfg.output_path}/epoch={epoch}")
        rows.repartitionByRange("batch").sortWithinPartitions("batch", "slot", "draw").write.mode("overwrite").parquet(paths[-1])
    return paths
