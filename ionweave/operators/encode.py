"""Stage 1: spectra to unit vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionweave.config import ClusterConfig
from ionweave.functions import peaks as P
from ionweave.operators.tiles import vector_column

# Fixed values of the integer-hash projection.
_SIGN = (48271, 69621, 12345, 2147483647)


def _unit_rows(values: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(values, axis=1, keepdims=True)
    return values / np.where(length == 0, 1.0, length)


def projection_matrix(cfg: ClusterConfig) -> np.ndarray:
    """Seeded normal projection of the bins, columns of unit length."""
    proj = np.random.RandomState(cfg.seed).randn(cfg.n_bins, cfg.embed_dim).astype(np.float32)
    return proj / np.linalg.norm(proj, axis=0, keepdims=True)


def _cleaned(cfg) -> "Column":
    zipped = P.zipped()
    if cfg.remove_precursor_peaks:
        return P.without_precursor(zipped, tol=cfg.precursor_removal_tol_da)
    return zipped


def _sparse_rows(batch: pa.RecordBatch):
    """(row, bin, value) of a batch's bin lists in row and bin order.

    Several peaks in one bin count once, with the largest value.
    """
    lists = batch.column("bins")
    flat = lists.flatten()
    row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().fill_null(0).to_numpy())
    bins = flat.field("bin").to_numpy(zero_copy_only=False).astype(np.int64)
    value = flat.field("v").to_numpy(zero_copy_only=False)
    order = np.lexsort((-value, bins, row))
    row, bins, value = row[order], bins[order], value[order]
    first = np.ones(len(row), dtype=bool)
    first[1:] = (row[1:] != row[:-1]) | (bins[1:] != bins[:-1])
    return row[first], bins[first], value[first]


def _projected(lists: DataFrame, dim: int, rows_of, kind) -> DataFrame:
    """Unit rows of sparse bins times a matrix whose rows ``rows_of(bins)`` supplies."""

    def run(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            row, bins, value = _sparse_rows(batch)
            total = np.zeros((batch.num_rows, dim))
            if len(row):
                starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
                total[row[starts]] = np.add.reduceat(rows_of(bins) * value[:, None], starts, axis=0)
            yield pa.RecordBatch.from_pydict(
                {"idx": batch.column("idx"), "embedding": vector_column(_unit_rows(total), kind)})

    name = "float" if kind == pa.float32() else "double"
    return lists.mapInArrow(run, f"idx long, embedding array<{name}>")


def encode_projection(spectra: DataFrame, cfg: ClusterConfig, planes: str = "gaussian") -> DataFrame:
    """``(idx, embedding)`` by projecting binned spectra.

    Binning is done on the JVM side and stays sparse.  The normal projection has a fixed size
    (bins x dimensions, 37 MB by default) and is broadcast; ``planes="hashed"`` takes signs
    from an integer hash instead, in double precision.
    """
    sparse = spectra.select("idx", P.binned(P.zipped(), cfg.top_k_peaks, cfg.mz_min, cfg.bin_width,
                                            cfg.n_bins).alias("bins"))
    if planes == "hashed":
        return _projected(sparse, cfg.embed_dim, _hashed_signs(cfg.embed_dim), pa.float64())
    shared = spectra.sparkSession.sparkContext.broadcast(projection_matrix(cfg))
    return _projected(sparse, cfg.embed_dim, lambda bins: shared.value[bins], pa.float32())


def _hashed_signs(dim: int):
    """Rows of +1 and -1 for bins; never materialised for all of them."""
    a, b, c, m = _SIGN
    place = np.arange(dim, dtype=np.int64)[None, :]

    def signs(bins):
        own, back = np.unique(bins, return_inverse=True)  # spectra share bins; a row is made once for a batch
        at = own[:, None]
        return np.where((at * a + (place * b + c)) * (at + place + 1) % m // 64 % 2 == 0, 1.0, -1.0)[back]

    return signs


def signed_projection(bins: DataFrame, dim: int) -> DataFrame:
    """``(idx, embedding)`` from sparse bins ``(idx, bin, v)`` with integer-hash signs.

    A spectrum has at most top-k bins, which bounds its list.
    """
    lists = bins.groupBy("idx").agg(F.collect_list(F.struct("bin", "v")).alias("bins"))
    return _projected(lists, dim, _hashed_signs(dim), pa.float64())


# --- transformer -------------------------------------------------------------------


def parameter_shapes(cfg) -> dict[str, tuple[int, ...]]:
    """Names and shapes of the encoder parameters."""
    d, f = cfg.embed_dim, cfg.ff_dim
    shapes = {"input_proj.weight": (d, 2), "input_proj.bias": (d,)}
    for layer in range(cfg.n_layers):
        p = f"encoder.layers.{layer}."
        shapes.update({
            p + "self_attn.in_proj_weight": (3 * d, d), p + "self_attn.in_proj_bias": (3 * d,),
            p + "self_attn.out_proj.weight": (d, d), p + "self_attn.out_proj.bias": (d,),
            p + "linear1.weight": (f, d), p + "linear1.bias": (f,),
            p + "linear2.weight": (d, f), p + "linear2.bias": (d,),
            p + "norm1.weight": (d,), p + "norm1.bias": (d,), p + "norm2.weight": (d,), p + "norm2.bias": (d,)})
    shapes.update({"proj_norm.0.weight": (d, d), "proj_norm.0.bias": (d,),
                   "proj_norm.1.weight": (d,), "proj_norm.1.bias": (d,)})
    return shapes


def random_parameters(cfg, seed: int = 42) -> dict[str, np.ndarray]:
    """Seeded initial parameters: uniform weights, zero biases, unit norms."""
    rng = np.random.default_rng(seed)
    out = {}
    for name, shape in parameter_shapes(cfg).items():
        if len(shape) == 2:
            bound = (6.0 / sum(shape)) ** 0.5
            out[name] = rng.uniform(-bound, bound, shape)
        else:
            out[name] = np.ones(shape) if "norm" in name and name.endswith("weight") and "proj_norm.0" not in name \
                else np.zeros(shape)
    return out


def checked_parameters(state: dict, cfg) -> dict[str, np.ndarray]:
    """Parameters of a checkpoint; a missing or unknown name is an error.

    Parameters of the training-only projection head are ignored.
    """
    wanted = parameter_shapes(cfg)
    missing = sorted(set(wanted) - set(state))
    unknown = sorted(n for n in set(state) - set(wanted) if not n.startswith("proj_head"))
    if missing or unknown:
        raise ValueError(f"encoder weights do not fit: missing {missing}, unexpected {unknown}")
    wrong = [n for n, shape in wanted.items() if tuple(np.shape(state[n])) != shape]
    if wrong:
        raise ValueError(f"encoder weights have other shapes: {wrong}")
    return {n: np.asarray(state[n], dtype=np.float64) for n in wanted}


def _layer_norm(x, weight, bias):
    centred = x - x.mean(-1, keepdims=True)
    return centred / np.sqrt((centred * centred).mean(-1, keepdims=True) + 1e-5) * weight + bias


def transformer_forward(tokens: np.ndarray, padding: np.ndarray, par: dict, heads: int) -> np.ndarray:
    """Unit vectors of a token batch ``(rows, length, 2)``; a row of padding only gives zeros."""
    x = tokens @ par["input_proj.weight"].T + par["input_proj.bias"]
    rows, length, d = x.shape
    empty = padding.all(1)
    hidden = np.where(padding & ~empty[:, None], -np.inf, 0.0)[:, None, None, :]
    layer = 0
    while f"encoder.layers.{layer}.norm1.weight" in par:
        p = f"encoder.layers.{layer}."
        y = _layer_norm(x, par[p + "norm1.weight"], par[p + "norm1.bias"])
        qkv = y @ par[p + "self_attn.in_proj_weight"].T + par[p + "self_attn.in_proj_bias"]
        q, k, v = (part.reshape(rows, length, heads, d // heads).transpose(0, 2, 1, 3)
                   for part in np.split(qkv, 3, axis=-1))
        score = q @ k.transpose(0, 1, 3, 2) / np.sqrt(d // heads) + hidden
        score = np.exp(score - score.max(-1, keepdims=True))
        mixed = (score / score.sum(-1, keepdims=True)) @ v
        mixed = mixed.transpose(0, 2, 1, 3).reshape(rows, length, d)
        x = x + mixed @ par[p + "self_attn.out_proj.weight"].T + par[p + "self_attn.out_proj.bias"]
        y = _layer_norm(x, par[p + "norm2.weight"], par[p + "norm2.bias"])
        y = np.maximum(y @ par[p + "linear1.weight"].T + par[p + "linear1.bias"], 0.0)
        x = x + y @ par[p + "linear2.weight"].T + par[p + "linear2.bias"]
        layer += 1
    valid = (~padding)[:, :, None]
    pooled = (x * valid).sum(1) / np.maximum(valid.sum(1), 1)
    out = pooled @ par["proj_norm.0.weight"].T + par["proj_norm.0.bias"]
    out = _unit_rows(_layer_norm(out, par["proj_norm.1.weight"], par["proj_norm.1.bias"]))
    out[empty] = 0.0
    return out


def encode_tokens(tokens: DataFrame, cfg, parameters: dict, rows_per_step: int = 256) -> DataFrame:
    """``(idx, embedding)`` of ``(idx, tokens array<struct<norm_mz, norm_int>>)``.

    The parameters have a fixed size (about 1 MB by default) and are broadcast.
    """
    shared = tokens.sparkSession.sparkContext.broadcast(parameters)
    heads, dim = cfg.n_heads, cfg.embed_dim

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, rows_per_step):
                part = batch.slice(at, rows_per_step)
                lists = part.column("tokens")
                count = lists.value_lengths().fill_null(0).to_numpy()
                length = max(1, int(count.max()))
                flat = lists.flatten()
                row = np.repeat(np.arange(part.num_rows), count)
                col = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                grid = np.zeros((part.num_rows, length, 2))
                grid[row, col, 0] = flat.field("norm_mz").to_numpy(zero_copy_only=False)
                grid[row, col, 1] = flat.field("norm_int").to_numpy(zero_copy_only=False)
                padding = np.arange(length)[None, :] >= count[:, None]
                out = transformer_forward(grid, padding, shared.value, heads)
                yield pa.RecordBatch.from_pydict(
                    {"idx": part.column("idx"), "embedding": vector_column(out.reshape(-1, dim), pa.float32())})

    return tokens.mapInArrow(run, "idx long, embedding array<float>")


def encode_transformer(spectra: DataFrame, cfg, parameters: dict) -> DataFrame:
    tokens = P.tokens(_cleaned(cfg), cfg.top_k_peaks, cfg.mz_min, cfg.mz_max)
    return encode_tokens(spectra.select("idx", tokens.alias("tokens")), cfg, parameters)


def encode(spectra: DataFrame, cfg: ClusterConfig) -> DataFrame:
    """Encoder by settings: given weights, else a random-weight transformer, else projection."""
    if cfg.encoder_weights:
        from ionweave.sources.store import read_parameters
        return encode_transformer(spectra, cfg, checked_parameters(read_parameters(cfg.encoder_weights), cfg))
    if cfg.use_transformer:
        return encode_transformer(spectra, cfg, random_parameters(cfg, cfg.seed))
    return encode_projection(spectra, cfg)
