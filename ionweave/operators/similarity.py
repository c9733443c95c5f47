"""Hash codes and the precursor-checked similarity graph."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionweave.config import ClusterConfig
from ionweave.functions.mass import edge_weight
from ionweave.functions.vectors import hash_bit_count
from ionweave.operators.graph import symmetric
from ionweave.operators.tiles import TILE_ROWS, matrix, nearest, nearest_of_copies, ranked_copies, vector_column

# Fixed values of the integer-hash planes.
_PLANE = (48271, 69621, 40692, 2147483647)


def gaussian_planes(dim: int, bits: int, seed: int) -> np.ndarray:
    """Seeded normal hyperplanes, one column per bit."""
    return np.random.default_rng(seed).standard_normal((dim, bits)).astype(np.float32).astype(np.float64)


def hashed_planes(dim: int, bits: int, repeat: int) -> np.ndarray:
    """Hyperplanes of +1 and -1 from an integer hash, so that SQL can rebuild them."""
    a, b, c, m = _PLANE
    pos, bit = np.arange(dim, dtype=np.int64)[:, None], np.arange(bits, dtype=np.int64)[None, :]
    mixed = ((pos + 1) * a + (bit + 1) * b + (repeat + 1) * c) * (pos + bit * 7 + repeat * 13 + 1) % m
    return np.where(mixed // 64 % 2 == 0, 1.0, -1.0)


def hash_codes(vectors: DataFrame, bits: int, repeats: int, seed: int = 42, planes: str = "gaussian") -> DataFrame:
    """Adds ``codes``: one sign-bit code per repeat.  The planes are a few kilobytes."""
    rest = [f for f in vectors.schema.fields]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest) + ", codes array<bigint>"

    def run(batches):
        stacked = None
        weight = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            vec = matrix(batch.column("embedding"))
            if stacked is None:
                make = gaussian_planes if planes == "gaussian" else hashed_planes
                base = seed if planes == "gaussian" else 0
                stacked = np.concatenate([make(vec.shape[1], bits, base + r) for r in range(repeats)], axis=1)
            signs = (vec @ stacked > 0).reshape(len(vec), repeats, bits).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, vector_column(signs @ weight, pa.int64())], names=[*batch.schema.names, "codes"])

    return vectors.mapInArrow(run, schema)


def bin_hash_codes(bins: DataFrame, bits: int, repeats: int, seed: int = 42) -> DataFrame:
    """Sign-bit codes straight from sparse bins ``(idx, bin, v)``, as ``(idx, codes)``.

    The sign of a bin on a plane comes from an integer hash of both, as in :func:`hashed_planes`
    with the seed as first repeat, so no plane is ever built; partial sums combine map-side.
    """
    a, b, c, m = _PLANE
    pos = F.col("bin").cast("bigint")

    def signed(rep, bit):
        mixed = ((pos + 1) * a + F.lit((bit + 1) * b + (rep + 1) * c)) * (pos + F.lit(bit * 7 + rep * 13 + 1)) % m
        return F.sum(F.when(F.floor(mixed / 64) % 2 == 0, F.col("v")).otherwise(-F.col("v")))

    sums = bins.select(F.col("idx").cast("bigint").alias("idx"), "bin", "v").groupBy("idx").agg(
        *[signed(seed + r, k).alias(f"_s{r * bits + k}") for r in range(repeats) for k in range(bits)])
    codes = []
    for r in range(repeats):
        code = F.lit(0).cast("bigint")
        for b in range(bits):
            code = code + F.when(F.col(f"_s{r * bits + b}") > 0, F.lit(1 << b)).otherwise(F.lit(0)).cast("bigint")
        codes.append(code)
    return sums.select("idx", F.array(*codes).alias("codes"))


def bucketed_rows(coded: DataFrame) -> DataFrame:
    """One row per repeat: adds ``rep`` and ``code``."""
    others = [c for c in coded.columns if c != "codes"]
    return coded.select(*others, F.posexplode("codes").alias("rep", "code"))


def candidate_pairs(vectors: DataFrame, k: int, coded: bool = False, floor: float = 0.0,
                    tile_rows: int = TILE_ROWS) -> DataFrame:
    """Directed candidate pairs with both precursors.

    Plain: k nearest over everything.  ``coded``: k nearest inside each hash bucket of
    each repeat, then the union over repeats with the largest similarity.
    """
    carried = ["precursor_mz", "precursor_charge"]
    if not coded:
        return nearest(vectors.select("idx", "embedding", *carried), k, (), carried, floor, tile_rows)
    # copies share their codes, so they are found once and not again in every repeat
    rows = bucketed_rows(ranked_copies(vectors.select("idx", "embedding", *carried, "codes"), k + 1, ["codes"]))
    near = nearest_of_copies(rows, k, ("rep", "code"), carried, floor, tile_rows)
    return near.groupBy("i", "j").agg(
        F.max("cos").alias("cos"), *[F.first(f"{c}_{s}").alias(f"{c}_{s}") for c in carried for s in "ij"])


def directed_edges(pairs: DataFrame, cfg: ClusterConfig) -> DataFrame:
    """Candidate pairs that pass the precursor rule and the weight threshold."""
    w = edge_weight("cos", "precursor_mz_i", "precursor_charge_i", "precursor_mz_j", "precursor_charge_j",
                    cfg.precursor_tol_ppm, cfg.precursor_tol_da)
    return pairs.select("i", "j", w.alias("w")).filter(F.col("w") >= cfg.edge_threshold)


def similarity_graph(vectors: DataFrame, cfg: ClusterConfig, n_rows: int, bin_codes: DataFrame = None,
                     tile_rows: int = TILE_ROWS) -> DataFrame:
    """Symmetric weighted edges ``(i, j, w)`` of rows ``(idx, embedding, precursor_mz, precursor_charge)``.

    The precursor test comes after the neighbour limit.  A weight never exceeds its
    cosine, so neighbours below the threshold are dropped while ranking.
    """
    k = max(1, min(cfg.ann_n_neighbours, n_rows - 1))
    coded = cfg.use_hd_prefilter
    if coded:
        bits = hash_bit_count(n_rows, cfg.hd_target_bucket_size)
        if cfg.use_encoder:
            vectors = hash_codes(vectors, bits, max(1, cfg.hd_n_repeats), cfg.hd_seed)
        else:
            vectors = vectors.join(bin_codes, "idx")
    pairs = candidate_pairs(vectors, k, coded, max(0.0, cfg.edge_threshold), tile_rows)
    return symmetric(directed_edges(pairs, cfg))
