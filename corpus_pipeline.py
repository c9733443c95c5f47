"""A training-text pipeline over ``documents``: every stage applies one text operator to what the one before kept.

Each stage takes ``(spark, docs, sf_dir)`` and works on all of ``docs``.  Missing and empty texts, ties, repeated
rows and empty tables are treated as the operators' docstrings say.  Further columns of ``docs`` come back unchanged,
whatever their names; only the last stage adds a column, ``copy``, which replaces one of that name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ionweave.llm import decontaminate, mixing, simhash, toxicity
from ionweave.llm.common import documents, small_batches, stored
from ionweave.llm.line_dedup import drop_shared_lines
from ionweave.session import ship_package


def _aside(docs: DataFrame, *names: str) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns of these names renamed, and the names to give them back."""
    moved = {name: f"_own_{name}" for name in names if name in docs.columns}
    return docs.withColumnsRenamed(moved), {b: a for a, b in moved.items()}


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.5 or more go; the model learns from the labelled rows not held out."""
    ship_package(spark)
    small_batches(spark)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows, back = _aside(docs, "score")
    return toxicity.score(rows, model).filter("score < 0.5").drop("score").withColumnsRenamed(back).select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 20 or more characters in 3 or more documents stay in the document with the largest id only."""
    rows, back = _aside(docs, "n_lines", "n_dropped")
    return drop_shared_lines(rows).drop("n_lines", "n_dropped").withColumnsRenamed(back).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies (five-word shingles, similarity 0.8 or more) the document with the smallest id stays."""
    ship_package(spark)
    small_batches(spark)
    return simhash.one_of_each_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold at least half of a test item of three or more words, aligned word by word, go."""
    ship_package(spark)
    small_batches(spark)
    found = decontaminate.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), least_words=3)
    # as a table, so that texts are not aligned and shuffled at the same time
    return decontaminate.without_contaminated(docs, stored(found, "pipeline-contaminated"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Poisson replication to weights that grow with the square root of a source's characters; ``copy`` counts from 1."""
    return mixing.replicate(docs, mixing.source_rates(docs))


STAGES = [
    ("toxicity", toxicity_filter),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("source_mixing", source_mixing),
]

#: Toxicity, SimHash and alignment can't be said in SQL; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table; each result is written as Parquet and read again as the next one's input."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
