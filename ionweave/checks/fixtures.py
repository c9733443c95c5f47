"""Spectrum-shaped views over the test tables; each has a SQL twin in ``VIEWS``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionweave.session import dealt_out

# One definition serves Spark and the SQL oracle; names of functions used are common to both.
VIEWS = {
    "fx_spectra": """
        SELECT o_orderkey AS idx,
               concat('scan_', cast(o_orderkey AS varchar(20))) AS scan_id,
               cast(CASE WHEN o_custkey % 10 = 0 THEN -1 ELSE o_custkey END AS bigint) AS label,
               cast(1 + o_custkey % 3 AS int) AS precursor_charge,
               cast(o_orderkey % 4 AS int) AS alt_charge,
               cast(500 AS double) + cast(o_custkey % 400 AS double)
                 + cast(o_orderkey % 7 AS double) * cast(0.001 AS double)
                 + CASE WHEN o_orderkey % 5 = 0
                        THEN cast(15.9949 AS double) / cast(1 + o_custkey % 3 AS double)
                        ELSE cast(0 AS double) END AS precursor_mz,
               cast(o_orderkey % 7200 AS double) AS rt,
               concat('run_', o_orderstatus, '.mgf') AS source_file
        FROM orders""",
    "fx_peaks": """
        SELECT l_orderkey AS idx,
               cast(150.007 AS double) + cast((o_custkey * 31 + l_linenumber * 97) % 1200 AS double)
                 + cast(l_suppkey % 3 AS double) * cast(0.005 AS double)
                 + CASE WHEN o_orderkey % 5 = 0 AND l_linenumber % 2 = 0
                        THEN cast(15.9949 AS double) ELSE cast(0 AS double) END AS mz,
               cast(l_extendedprice AS double) AS intensity
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "fx_sup_peaks": """
        SELECT l_suppkey AS idx,
               cast(40.007 AS double)
                 + cast((l_partkey * 37 + l_linenumber * 101) % 75000 AS double) * cast(0.02 AS double) AS mz,
               cast(l_extendedprice AS double) AS intensity
        FROM lineitem""",
    "fx_vectors": """
        SELECT vec_id AS idx, embedding, cast(label AS bigint) AS label,
               cast(vec_id % 4 AS int) AS precursor_charge,
               cast(500 AS double) + cast(vec_id % 5 AS double) * cast(0.002 AS double) AS precursor_mz,
               concat('run_', cast(vec_id % 3 AS varchar(5)), '.mgf') AS source_file
        FROM embeddings""",
    "fx_psm": """
        SELECT cast(l_orderkey AS varchar(20)) AS scan_id,
               upper(trim(concat(p_type, '_', p_brand))) AS peptide,
               cast(l_discount AS double) AS q_value, cast(l_quantity AS double) AS score,
               cast(l_extendedprice AS double) AS price, l_linenumber AS line, l_partkey AS part
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
}

SOURCES = {
    "fx_spectra": ["orders"],
    "fx_peaks": ["lineitem", "orders"],
    "fx_sup_peaks": ["lineitem"],
    "fx_vectors": ["embeddings"],
    "fx_psm": ["lineitem", "part"],
}
# Keys by which large tables of a view are dealt out before they are joined.
DEALT = {"fx_peaks": {"lineitem": "l_orderkey", "orders": "o_orderkey"}}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    frames = {t: table(spark, sf_dir, t) for t in SOURCES[name]}
    if name in DEALT:
        frames = dealt_out(frames, DEALT[name])
    text = VIEWS[name]
    for t in frames:
        text = text.replace(f"FROM {t}", f"FROM {{{t}}} AS {t}").replace(f"JOIN {t} ", f"JOIN {{{t}}} AS {t} ")
    return spark.sql(text, **frames)


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "fx_spectra").filter(F.col("label") >= 0)
