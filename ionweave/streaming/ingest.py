"""New MGF files as they arrive: parse and encode in micro-batches, append to tables.

Reading and encoding have no state between spectra.  Clustering needs all of them and
stays a batch job over the tables written here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionweave.config import ClusterConfig
from ionweave.functions import peaks as P
from ionweave.operators.encode import encode
from ionweave.session import checkpoint, dense_positions
from ionweave.sources.mgf import RECORD_START, parse_blocks, split_records, with_start

#: Rows of a batch have numbers below 2^33.
BATCH_SHIFT = 33


def spectra_stream(spark: SparkSession, folder: str, cfg: ClusterConfig = ClusterConfig(),
                   start: str = RECORD_START) -> DataFrame:
    """Streaming spectra of the ``*.mgf`` files in a folder, without ids."""
    raw = (spark.readStream.option("lineSep", start).option("pathGlobFilter", "*.mgf").text(folder)
           .select(with_start(F.col("value"), start).alias("value"), F.col("_metadata.file_name").alias("source_file")))
    parsed = parse_blocks(split_records(raw)).filter((F.size("mz") > 0) & ~F.col("corrupt"))
    if cfg.quality_filter_enabled:
        parsed = parsed.filter(P.passes_quality("mz", cfg.quality_min_peaks, cfg.quality_min_mz_range))
    return parsed.select(
        F.col("title").alias("scan_id"),
        "precursor_mz", "precursor_charge", "mz", "intensity", "rt", "source_file")


def start_ingest(spark: SparkSession, folder: str, target: str, state: str, cfg: ClusterConfig = ClusterConfig(),
                 once: bool = True):
    """Append spectra with their vectors to the parquet table ``target``.

    An id is the batch in the upper 30 bits and a dense number in the batch in the lower 33: equal spectra stay apart, however
    many tasks a batch has, and a repeated batch replaces its own rows.
    """
    spectra = spectra_stream(spark, folder, cfg)

    def append(batch: DataFrame, batch_id: int) -> None:
        fixed = checkpoint(batch)  # the vectors must meet the same numbers
        numbered = dense_positions(fixed, "idx").withColumn("idx", F.col("idx") + F.lit(batch_id << BATCH_SHIFT).cast("bigint"))
        rows = numbered.join(encode(numbered, cfg), "idx")
        # one folder per batch: a repeated batch replaces its own output
        rows.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    writer = spectra.writeStream.foreachBatch(append).option("checkpointLocation", state)
    return writer.trigger(availableNow=True).start() if once else writer.start()
