"""Stage cache and encoder parameter files."""

from __future__ import annotations

import hashlib
import io
import json
from dataclasses import asdict

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionweave.sources.archive import read_archive


def fingerprint(spectra: DataFrame, cfg, stage: str) -> str:
    """Key of a cached stage: the settings that matter and a digest of the input rows."""
    row = spectra.agg(F.count("*").alias("n"),
                      F.bit_xor(F.xxhash64(*[c for c in spectra.columns])).alias("x"),
                      F.sum(F.xxhash64(*[c for c in spectra.columns]).cast("decimal(38,0)")).alias("s")).first()
    settings = {k: v for k, v in asdict(cfg).items() if k not in ("output_dir", "resume", "verbose")}
    text = json.dumps([stage, str(row["n"]), str(row["x"]), str(row["s"]), settings], default=str, sort_keys=True)
    return hashlib.sha256(text.encode()).hexdigest()[:20]


def cached(spark: SparkSession, folder: str, key: str, build) -> DataFrame:
    """The table ``key`` under ``folder``, built and written when it is not there yet."""
    path = f"{folder}/{key}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """Write a small driver-side file to any file system Spark knows."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def write_parameters(path: str, parameters: dict, **metadata) -> None:
    """Save encoder parameters with their metadata in one file (a few megabytes), where Spark can read it."""
    arrays = {f"state/{name}": np.asarray(value) for name, value in parameters.items()}
    out = io.BytesIO()
    np.savez(out, metadata=np.array(json.dumps(metadata, default=str)), **arrays)
    write_bytes(SparkSession.builder.getOrCreate(), path, out.getvalue())


def _load(path: str) -> tuple[dict, dict]:
    spark = SparkSession.builder.getOrCreate()
    data = io.BytesIO(spark.read.format("binaryFile").load(path).select("content").first()["content"])
    if path.endswith((".pt", ".pth")):
        raw = read_archive(data.getvalue())
        state = raw.get("model_state_dict", raw)
        meta = {k: v for k, v in raw.items() if k != "model_state_dict"} if "model_state_dict" in raw else {}
        return {k: np.asarray(v) for k, v in state.items()}, meta
    with np.load(data, allow_pickle=False) as arrays:
        state = {n[len("state/"):]: arrays[n] for n in arrays.files if n.startswith("state/")}
        meta = json.loads(str(arrays["metadata"])) if "metadata" in arrays.files else {}
    return state, meta


def read_parameters(path: str) -> dict[str, np.ndarray]:
    return _load(path)[0]


def training_settings(path: str) -> dict:
    """Settings an encoder was trained with, as far as its file names them."""
    return _load(path)[1].get("cfg") or {}


def describe_checkpoint(spark: SparkSession, path: str) -> DataFrame:
    """Metadata of a parameter file as one row."""
    state, meta = _load(path)

    def value(name):
        return float(meta[name]) if meta.get(name) is not None else None

    row = (path, meta.get("epoch"), value("train_loss"), value("val_intra_sim"), value("val_inter_sim"),
           value("val_separation"), len(state), int(sum(np.size(v) for v in state.values())))
    return spark.createDataFrame(
        [row], "path string, epoch int, train_loss double, val_intra_sim double, val_inter_sim double, "
               "val_separation double, n_tensors int, n_parameters long")
