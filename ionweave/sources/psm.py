"""Peptide-match tables as ``(scan_id, peptide)``."""

from __future__ import annotations

from typing import Optional

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionweave.functions.text import number, peptide_text

# Fixed column names of search-engine exports, in order of preference.
Q_VALUE_NAMES = ["Percolator q-Value", "q-Value", "q_value", "FDR"]
PEPTIDE_NAMES = ["Annotated Sequence", "Sequence", "Peptide", "peptide"]
SCAN_NAMES = ["First Scan", "Spectrum File", "ScanNum", "scan", "TITLE"]
SCORE_NAMES = ["Confidence", "XCorr", "Ions Score", "Percolator SVM Score", "Score"]


def separator(path: str, tab_suffixes=None) -> str:
    """Tab unless the file is .csv; with ``tab_suffixes`` comma unless it ends in one of them."""
    if tab_suffixes is not None:
        return "\t" if path.endswith(tuple(tab_suffixes)) else ","
    return "," if path.lower().endswith(".csv") else "\t"


def first_column(df: DataFrame, names) -> Optional[str]:
    return next((n for n in names if n in df.columns), None)


def _read(spark: SparkSession, path: str, sep: str, comment: str = None) -> DataFrame:
    reader = spark.read.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"')
    if comment:
        reader = reader.option("comment", comment)
    df = reader.csv(path)
    return df.toDF(*[c.strip() for c in df.columns])


def _named(df: DataFrame, name: str):
    return F.col("`" + name.replace("`", "``") + "`")


def below_fdr(df: DataFrame, column: Optional[str], fdr: float) -> DataFrame:
    """Rows whose numeric value is at most ``fdr``; everything when there is no such column."""
    return df.filter(number(_named(df, column)) <= fdr) if column else df


def best_hits(df: DataFrame, score=None, ties=()) -> DataFrame:
    """One row per scan: highest score, then the tie columns.

    An aggregate keeps one candidate per scan in every task before the shuffle.
    """
    score = F.lit(None).cast("double") if score is None else score
    order = F.struct(F.coalesce(score, F.lit(float("-inf"))), *ties)
    return df.groupBy("scan_id").agg(F.max_by("peptide", order).alias("peptide"))


def _keys(df: DataFrame, scan: str, peptide: str) -> DataFrame:
    return df.filter(_named(df, scan).isNotNull() & _named(df, peptide).isNotNull()).withColumns({
        "_scan": F.trim(_named(df, scan).cast("string")), "_peptide": peptide_text(_named(df, peptide))})


def from_proteome_discoverer(df: DataFrame, fdr: float = 0.01) -> DataFrame:
    peptide, scan = first_column(df, PEPTIDE_NAMES), first_column(df, SCAN_NAMES)
    if peptide is None or scan is None:
        raise ValueError(f"no {'peptide' if peptide is None else 'scan'} column among {df.columns}")
    df = below_fdr(df, first_column(df, Q_VALUE_NAMES), fdr)
    present = [c for c in SCORE_NAMES if c in df.columns]
    # an all-text score column says nothing: take the first one with a numeric value
    score = None
    if present:
        counts = df.agg(*[F.count(number(_named(df, c))).alias(f"n{i}") for i, c in enumerate(present)]).first()
        usable = [c for i, c in enumerate(present) if counts[i] > 0]
        score = number(_named(df, usable[0])) if usable else None
    rows = _keys(df, scan, peptide)
    rows = rows.select(F.col("_scan").alias("scan_id"), F.col("_peptide").alias("peptide"),
                       (score if score is not None else F.lit(None).cast("double")).alias("_score"))
    return best_hits(rows, F.col("_score"), [F.col("peptide")])


def from_comet(df: DataFrame, fdr: float = 0.01) -> DataFrame:
    df = below_fdr(df, "e-value" if "e-value" in df.columns else None, fdr)
    peptide = first_column(df, ["plain_peptide", "peptide", "modified_peptide"])
    scan = first_column(df, ["scan", "scan_id"])
    rows = _keys(df, scan, peptide)
    return rows.select(F.col("_scan").alias("scan_id"), F.col("_peptide").alias("peptide")).distinct()


def from_generic(df: DataFrame, fdr: float = 0.01, scan_col: str = "scan_id", peptide_col: str = "peptide",
                 qval_col: str = "q_value") -> DataFrame:
    df = below_fdr(df, qval_col if qval_col in df.columns else None, fdr)
    rows = _keys(df, scan_col, peptide_col)
    return rows.select(F.col("_scan").alias("scan_id"), F.col("_peptide").alias("peptide")).distinct()


def read_psm(spark: SparkSession, path: str, fmt: str = "proteome_discoverer", fdr: float = 0.01,
             **columns) -> DataFrame:
    """Read a match table; an unknown format is read as generic."""
    if fmt == "proteome_discoverer":
        return from_proteome_discoverer(_read(spark, path, separator(path)), fdr)
    if fmt == "comet":
        return from_comet(_read(spark, path, "\t", "#"), fdr)
    return from_generic(_read(spark, path, separator(path, (".tsv", ".txt"))), fdr, **columns)
