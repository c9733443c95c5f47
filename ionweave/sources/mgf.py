"""MGF text as spectrum rows.

Files are read as text records that start at a ``BEGIN IONS`` line, so one large file is
split over many tasks.  Parsing is column expressions only.
"""

from __future__ import annotations

import re
from typing import Iterable, Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ionweave.functions import peaks as P
from ionweave.functions import text as T
from ionweave.session import checkpoint, ordered_index

RECORD_START = "\nBEGIN IONS"
BROADCAST_SPLITS = 100_000
_BEGIN = r"(?im)^[ \t]*BEGIN IONS[ \t]*\r?$"
_END = r"(?im)^[ \t]*END IONS[ \t]*\r?$"


def expand_paths(spark: SparkSession, paths) -> list[str]:
    """A path, a comma list or a list; a directory stands for its ``*.mgf`` files by name."""
    raw = [p.strip() for p in paths.split(",") if p.strip()] if isinstance(paths, str) else list(paths)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    out = []
    for p in raw:
        path = hadoop(p)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.isDirectory(path):
            names = [str(s.getPath().toString()) for s in fs.listStatus(path) if s.getPath().getName().endswith(".mgf")]
            out.extend(sorted(names))
        else:
            out.append(p)
    return out


def _header(headers: Column, *names: str) -> Column:
    """Value of the last header with one of the names."""
    hits = F.filter(headers, lambda h: h["key"].isin(*names))
    return F.try_element_at(hits, F.lit(-1))["val"]


def parse_blocks(blocks: DataFrame, block: str = "block") -> DataFrame:
    """Parse ion blocks (text after the last BEGIN IONS line) into columns.

    Adds title, scans, pepmass, charge, rt texts, ``mz`` and ``intensity``, and ``corrupt``
    for a block whose PEPMASS or CHARGE is not numeric.  A peak line whose first two
    tokens are not both numeric is skipped as a whole.
    """
    lines = F.filter(F.transform(F.split(block, r"\r?\n"), lambda s: F.trim(F.regexp_replace(s, r"\s+", " "))),
                     lambda s: (s != "") & ~s.startswith("#"))
    headers = F.transform(F.filter("_lines", lambda s: s.contains("=")), lambda s: F.struct(
        F.upper(F.trim(F.substring_index(s, "=", 1))).alias("key"),
        F.trim(F.substring(s, F.instr(s, "=") + 1, F.length(s))).alias("val")))
    tokens = F.transform(F.filter("_lines", lambda s: ~s.contains("=")), lambda s: F.split(s, " "))
    peaks = F.filter(F.transform(tokens, lambda t: F.struct(
        F.try_element_at(t, F.lit(1)).try_cast("double").alias("mz"),
        F.try_element_at(t, F.lit(2)).try_cast("double").alias("intensity"))),
        lambda p: p["mz"].isNotNull() & p["intensity"].isNotNull())
    pepmass = F.split(_header(F.col("_headers"), "PEPMASS"), r"\s+").getItem(0)
    charge = F.regexp_replace(_header(F.col("_headers"), "CHARGE"), r"[+\-]", "")
    # every time header that is a number replaces the one before it
    times = F.filter(F.transform(F.filter("_headers", lambda h: h["key"].isin("RTINSECONDS", "RETENTION_TIME", "RT")),
                                 lambda h: h["val"].try_cast("double")), lambda v: v.isNotNull())
    return (blocks.withColumn("_lines", lines).withColumn("_headers", headers).withColumn("_peaks", peaks)
            .withColumn("title", F.coalesce(_header(F.col("_headers"), "TITLE"), F.lit("")))
            .withColumn("scans", _header(F.col("_headers"), "SCANS"))
            .withColumn("_pepmass", pepmass).withColumn("_charge", F.trim(charge))
            .withColumn("precursor_mz", F.coalesce(F.col("_pepmass").try_cast("double"), F.lit(0.0)))
            .withColumn("precursor_charge", F.coalesce(F.col("_charge").try_cast("int"), F.lit(0)))
            .withColumn("rt", F.coalesce(F.try_element_at(times, F.lit(-1)), F.lit(0.0)))
            .withColumn("corrupt", (F.col("_pepmass").isNotNull() & F.col("_pepmass").try_cast("double").isNull())
                        | (F.col("_charge").isNotNull() & F.col("_charge").try_cast("int").isNull()))
            .withColumn("mz", F.transform("_peaks", lambda p: p["mz"].cast("float")))
            .withColumn("intensity", F.transform("_peaks", lambda p: p["intensity"].cast("float")))
            .drop("_lines", "_headers", "_peaks", "_pepmass", "_charge", block))


def split_records(records: DataFrame, record: str = "value") -> DataFrame:
    """Text records to ion blocks: one row per block, without the text between blocks.

    A block is what lies between its BEGIN and END lines, in any case; one without an END line is dropped.
    """
    ended = F.split(record, _END)
    pieces = F.explode(F.slice(ended, F.lit(1), F.size(ended) - 1))
    return (records.withColumn("_piece", pieces)
            .filter(F.col("_piece").rlike(_BEGIN))
            .withColumn("block", F.element_at(F.split("_piece", _BEGIN), -1))
            .drop("_piece", record))


def with_start(value: Column, start: str = RECORD_START) -> Column:
    """The record with the BEGIN line that the separator consumed; the first record of a file has its own."""
    return F.when(value.rlike(r"^[ \t]*\r?\n"), F.concat(F.lit(start), value)).otherwise(value)


def read_records(spark: SparkSession, files: Sequence[str], start: str = RECORD_START) -> DataFrame:
    """Text records with file, split and order columns."""
    raw = spark.read.option("lineSep", start).text(list(files))
    return raw.select(
        with_start(F.col("value"), start).alias("value"),
        F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_name").alias("source_file"),
        F.col("_metadata.file_block_start").alias("split_start"))


def file_ranks(files: Sequence[str], seen: Iterable[str]) -> dict[str, int]:
    """Place of every path in ``seen``, as Spark names it, among ``files``, as they were given.

    A path given without scheme and host is found by the end of the full one; files of one name in two folders keep their order.
    """
    def plain(path: str) -> str:
        return re.sub("^file:/+", "/", path)

    given = {plain(f): n for n, f in reversed(list(enumerate(files)))}

    def place(path: str) -> int:
        full = plain(unquote(path))
        return given[full] if full in given else min((n for f, n in given.items() if full.endswith(f)), default=len(given))

    return {path: place(path) for path in seen}


def read_mgf(spark: SparkSession, paths, quality: tuple = None, max_spectra: int = None,
             count_empty: bool = False, keep_corrupt: bool = False, start: str = RECORD_START) -> DataFrame:
    """Spectra ``(idx, scan_id, title, scans, precursor_mz, precursor_charge, mz, intensity, rt, source_file)``.

    ``idx`` follows file and text order.  A spectrum without a title is named by its
    number in the file, counting spectra with peaks (or all with ``count_empty``).
    ``quality`` is ``(min_peaks, min_mz_range)``.  ``start`` may be changed for files
    whose BEGIN lines are not in capitals; such lines are recognised anyway, but a file
    with none in capitals is then one record.
    """
    files = expand_paths(spark, paths)
    parsed = parse_blocks(split_records(read_records(spark, files, start)))
    if not count_empty:
        parsed = parsed.filter(F.size("mz") > 0)
    # positions inside a task follow the text; the parsed rows are kept, so the text is parsed once
    parsed = checkpoint(parsed.withColumn("_mid", F.monotonically_increasing_id()))
    splits = (parsed.groupBy("file_path", "split_start").agg(F.min("_mid").alias("_first"), F.count("*").alias("_n"))
              .collect())  # one row per file split
    rank = file_ranks(files, {r["file_path"] for r in splits})
    splits.sort(key=lambda r: (rank[r["file_path"]], r["file_path"], r["split_start"]))
    rows, total, before, current = [], 0, 0, None
    for r in splits:
        before = before if r["file_path"] == current else 0
        current = r["file_path"]
        rows.append((r["file_path"], r["split_start"], r["_first"], total, before))
        total, before = total + r["_n"], before + r["_n"]
    table = spark.createDataFrame(
        rows, "file_path string, split_start long, _first long, _total long, _before long")
    # the table grows with the number of file splits only; beyond the limit it is a plain join
    table = F.broadcast(table) if len(rows) <= BROADCAST_SPLITS else table
    offset = F.col("_mid") - F.col("_first")
    out = (parsed.join(table, ["file_path", "split_start"])
           .withColumn("idx", F.col("_total") + offset)
           .withColumn("_nth", F.col("_before") + offset + 1)
           .withColumn("scan_id", F.coalesce(F.nullif("title", F.lit("")),
                                             F.concat(F.lit("scan_"), F.col("_nth").cast("string"))))
           .filter(F.size("mz") > 0))
    if not keep_corrupt:
        out = out.filter(~F.col("corrupt"))
    if quality:
        out = out.filter(P.passes_quality("mz", *quality))
    columns = ["idx", "scan_id", "title", "scans", "precursor_mz", "precursor_charge", "mz", "intensity", "rt",
               "source_file"]
    out = out.select(*columns, *(["corrupt"] if keep_corrupt else []))
    return first_spectra(out, max_spectra) if max_spectra else out


def first_spectra(spectra: DataFrame, n: int) -> DataFrame:
    """The first ``n`` spectra in reading order; only ids are ordered to find the last of them."""
    last = ordered_index(spectra.select("idx"), "idx", name="_pos").filter(F.col("_pos") == n - 1).first()
    return spectra if last is None else spectra.filter(F.col("idx") <= last["idx"])


def training_spectra(spectra: DataFrame) -> DataFrame:
    """Spectra keyed by scan number for training; a later spectrum replaces an earlier one."""
    keyed = spectra.withColumn("scan_key", T.scan_key("scans", "title")).filter(F.col("scan_key").isNotNull())
    last = keyed.groupBy("scan_key").agg(F.max("idx").alias("idx"))
    return keyed.join(last, ["scan_key", "idx"]).drop("scan_id").withColumnRenamed("scan_key", "scan_id")
