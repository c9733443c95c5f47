"""Text clean-up for scan numbers, peptides and class labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed patterns for scan numbers inside titles.
SCANS_PATTERN = r"(?i)scans:\s*[\"']?(\d+)"
NEW_SCAN_PATTERN = r"(?i)NewScan:(\d+)"
DIGITS_PATTERN = r"^\d+$"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _found(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def scan_from_title(title) -> Column:
    """Scan number named in a title, or NULL."""
    t = _c(title)
    digits = F.when(F.trim(t).rlike(DIGITS_PATTERN), F.trim(t))
    return F.coalesce(_found(t, SCANS_PATTERN), _found(t, NEW_SCAN_PATTERN), digits)


def scan_key(scans, title) -> Column:
    """Explicit scan number up to the first separator, else the one in the title."""
    explicit = F.nullif(F.trim(F.split(_c(scans), r"[|;]").getItem(0)), F.lit(""))
    return F.coalesce(explicit, scan_from_title(title))


def peptide_text(peptide) -> Column:
    return F.upper(F.trim(_c(peptide).cast("string")))


def class_label(peptide, charge) -> Column:
    return F.concat(_c(peptide), F.lit("|z"), _c(charge).cast("string"))


def base_peptide(label) -> Column:
    """Class label without its charge suffix."""
    return F.regexp_replace(_c(label), r"\|z[^|]*$", "")


def number(text) -> Column:
    """Numeric value, NULL for anything else."""
    return _c(text).try_cast("double")
