"""Registered queries of the text operators, each over its whole tables."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionweave.llm import (
    decontaminate, exact_dedup, license_scan, line_dedup, lm_score, mixing, packing, secrets, simhash, spelling, token_counts, toxicity,
    vector_codes,
)
from ionweave.llm.common import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_license_scan(spark, d):
    docs = documents(spark, d)
    return license_scan.digest(license_scan.scan(docs, license_scan.token_order(docs)))


@query
def op2_toxicity(spark, d):
    docs, labels = documents(spark, d), spark.read.parquet(f"{d}/labels.parquet")
    return toxicity.predictions(docs, toxicity.fit(docs, labels))


@query
def op3_mixing(spark, d):
    docs = documents(spark, d)
    return mixing.replicate(docs, mixing.source_rates(docs))


@query
def op4_exact_dedup(spark, d):
    return exact_dedup.duplicate_groups(documents(spark, d))


@query
def op5_simhash(spark, d):
    return simhash.near_duplicates(documents(spark, d))


@query
def op6_token_counts(spark, d):
    return token_counts.token_totals(documents(spark, d), token_counts.tokenizer_path())


@query
def op7_decontamination(spark, d):
    return decontaminate.contaminated(documents(spark, d), spark.read.parquet(f"{d}/benchmark.parquet"))


@query
def op8_secrets(spark, d):
    docs = documents(spark, d)
    return secrets.digest(secrets.scan(docs, secrets.train(docs)))


@query
def op9_lm_score(spark, d):
    return lm_score.score_documents(documents(spark, d))


@query
def op10_line_dedup(spark, d):
    out = line_dedup.drop_shared_lines(documents(spark, d))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query
def op11_vector_codes(spark, d):
    return vector_codes.compressed(spark.read.parquet(f"{d}/embeddings.parquet"))


@query
def op12_spelling_variants(spark, d):
    return spelling.variants(documents(spark, d))


@query
def op13_best_fit_packing(spark, d):
    return packing.packed_documents(documents(spark, d), packing.tokenizer_path())
