"""Column expressions and helpers that the text operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ionweave.session import checkpoint_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; ``lower`` does that when every character is one byte."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def whole_row(docs: DataFrame) -> Column:
    """All columns as one struct, so that columns an operator adds can't clash with them."""
    return F.struct(*[F.col(f"`{name}`") for name in docs.columns])


def row_fields(names: list[str], row: str = "row") -> list[Column]:
    return [F.col(row)[name].alias(name) for name in names]


def stored(df: DataFrame, name: str, *parts: str) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder, in folders by ``parts``, and read it back; this cuts its lineage."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*parts).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucket(doc_id: Column, modulus: int = 5) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a missing id counts as the empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus).cast("int")


#: Bytes of rows that travel to a Python worker at once where whole texts do.
TEXT_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Let this session send texts to Python in batches of about ``TEXT_BYTES``; a caller's own limit wins.

    At Spark's own limits, 10,000 rows or 64 MB, a batch holds the texts of a whole task: once in the JVM, beside its heap, and
    as bytes, strings and results in Python.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if key not in spark.conf.getAll:
        spark.conf.set(key, TEXT_BYTES)


#: A key with more than this share of the rows is hot; there are at most 1000 of them.
HOT_SHARE = 1e-3


def spread_join(rows: DataFrame, keyed: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``keyed``, which has one row per key and the key's number of ``rows`` in ``weight``.

    Keys with more than a thousandth of the ``total`` rows can only be a thousand; they are broadcast, so that their
    rows stay where they are.  All other rows are shuffled to their keys.
    """
    limit = F.lit(total * HOT_SHARE)
    hot, rest = F.broadcast(keyed.filter(F.col(weight) > limit)), keyed.filter(F.col(weight) <= limit)
    return rows.join(hot, keys).unionByName(rows.join(hot.select(*keys), keys, "left_anti").join(rest, keys))
