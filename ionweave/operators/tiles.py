"""Blocked pair work on vectors.

A block (an LSH bucket, a cluster, or everything) is cut into tiles of bounded size by
a hash of the row id, and every pair of tiles becomes one group.  A group holds at most
two tiles whatever the size of its block, so a hot block is spread over many tasks; the
kernels return only a bounded number of rows per input row, never the pairs themselves.

Identical vectors are collapsed before any pair work: a large set of copies costs one
row (radius joins) or k + 1 rows (nearest neighbours).
"""

from __future__ import annotations

from typing import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ionweave.operators.graph import smallest_labels
from ionweave.operators.tile_index import WIDE_ROWS, tile_index, tile_size
from ionweave.session import checkpoint, small_rows

TILE_ROWS = 4096
CHUNK_CELLS = 1 << 21  # pairs of rows that a kernel looks at together
HOT_BLOCK_LIMIT = 100_000  # rows of block sizes that may be broadcast
COPY_PARTS = 256  # parts of a set of copies that are ranked apart
COSINE_DIGITS = 9  # similarities are rounded here so that ties rank the same everywhere


def matrix(column) -> np.ndarray:
    """2-d float64 array of an Arrow list column with equal-length rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if n == 0:
        return np.zeros((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def vector_column(values: np.ndarray, kind=pa.float64()) -> pa.Array:
    """Arrow list column of a 2-d array."""
    n, d = values.shape
    offsets = pa.array(np.arange(0, (n + 1) * d, d, dtype=np.int32)) if d else pa.array(np.zeros(n + 1, np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(values.ravel(), kind))


def _chunk(width: int) -> int:
    return max(64, min(512, CHUNK_CELLS // max(1, width)))


def tile_pairs(df: DataFrame, block: Sequence[str], row_id: str, tile_rows: int = TILE_ROWS, widest: int = WIDE_ROWS) -> DataFrame:
    """Replicate rows to the tile pairs of their block: adds ``tile``, ``ta`` and ``tb``.

    Large blocks get larger tiles, of up to ``widest`` rows, so that a row is copied a bounded number of times.
    """
    hot = (df.groupBy(*block).agg(F.count("*").alias("_rows"))
           .filter(F.col("_rows") > tile_rows)
           .select(*block, F.ceil(F.col("_rows") / tile_size(F.col("_rows"), tile_rows, widest)).cast("int").alias("_tiles")))
    n_hot, local = small_rows(hot, HOT_BLOCK_LIMIT)
    if n_hot == 0:
        return df.withColumn("tile", F.lit(0)).withColumn("ta", F.lit(0)).withColumn("tb", F.lit(0))
    sized = df.join(hot if local is None else F.broadcast(local), list(block), "left")
    tiles = F.coalesce(F.col("_tiles"), F.lit(1))
    return (sized.withColumn("tile", F.pmod(F.xxhash64(row_id), tiles).cast("int"))
            .withColumn("_other", F.explode(F.sequence(F.lit(0), tiles - 1)))
            .withColumn("ta", F.least("tile", "_other"))
            .withColumn("tb", F.greatest("tile", "_other"))
            .drop("_other", "_tiles"))


def collapse_copies(vectors: DataFrame, within: Sequence[str] = ()) -> DataFrame:
    """Adds ``vid``, the smallest id among rows with the same vector (inside ``within``)."""
    keys = [*within, "embedding"]
    ids = vectors.groupBy(*keys).agg(F.min("idx").alias("vid"))
    return vectors.join(ids, keys)


# --- nearest neighbours ------------------------------------------------------------


def _knn_kernel(block: Sequence[str], carried: Sequence[str], k: int, floor: float):
    """Per tile pair: the k most similar candidates of every query row."""

    def best(queries, q_ids, targets, t_ids):
        """(query position, target position, similarity), at most k per query."""
        found = []
        step = _chunk(len(targets))
        for at in range(0, len(queries), step):
            sims = np.round(np.maximum(queries[at:at + step] @ targets.T, 0.0), COSINE_DIGITS)
            if sims.shape[1] > k:
                kth = np.partition(sims, -k, axis=1)[:, -k]
                keep = sims >= np.maximum(kth, floor)[:, None]
            else:
                keep = sims >= floor
            q, t = np.nonzero(keep)
            order = np.lexsort((t_ids[t], -sims[q, t], q))
            q, t = q[order], t[order]
            first = np.searchsorted(q, q)
            q_, t_ = q[np.arange(len(q)) - first < k], t[np.arange(len(q)) - first < k]
            found.append((q_ + at, t_, sims[q_, t_]))
        return [np.concatenate(part) for part in zip(*found)] if found else [np.zeros(0, int)] * 3

    def kernel(table: pa.Table) -> pa.Table:
        tile = table.column("tile").to_numpy()
        ta, tb = table.column("ta")[0].as_py(), table.column("tb")[0].as_py()
        vec = matrix(table.column("embedding"))
        ids = table.column("idx").to_numpy()
        query = table.column("vid").to_numpy() == ids
        rows = np.arange(len(ids))
        sides = [(rows[tile == ta], rows[tile == tb])]
        if ta != tb:
            sides.append((sides[0][1], sides[0][0]))
        src, dst, sim = [], [], []
        for left, right in sides:
            left = left[query[left]]
            if len(left) == 0 or len(right) == 0:
                continue
            q, t, s = best(vec[left], ids[left], vec[right], ids[right])
            src.append(left[q.astype(int)])
            dst.append(right[t.astype(int)])
            sim.append(s)
        src = np.concatenate(src) if src else np.zeros(0, int)
        dst = np.concatenate(dst) if dst else np.zeros(0, int)
        sim = np.concatenate(sim).astype(np.float64) if sim else np.zeros(0)
        out = {name: table.column(name).take(pa.array(src)) for name in block}
        out["vid"] = pa.array(ids[src], pa.int64())
        out["j"] = pa.array(ids[dst], pa.int64())
        out["cos"] = pa.array(sim, pa.float64())
        for name in carried:
            out[f"{name}_j"] = table.column(name).take(pa.array(dst))
        return pa.table(out)

    return kernel


def ranked_copies(vectors: DataFrame, keep: int, within: Sequence[str] = ()) -> DataFrame:
    """Adds ``vid`` and the 1-based number ``copy`` of a row among the first ``keep`` of its copies, by id.

    Later copies get ``keep + 1``.  They are ranked in parts by a hash of the id first, and only the first ``keep`` of
    each part meet, so a vector that most rows share (zero vectors) is spread over many tasks.
    The result is read several times (block sizes, tiles, own rows), so it is checkpointed.
    """
    rows = collapse_copies(vectors, within).withColumn("_part", F.pmod(F.xxhash64("idx"), F.lit(COPY_PARTS)))
    part = Window.partitionBy(*within, "vid", "_part").orderBy("idx")
    rows = checkpoint(rows.withColumn("_nth", F.row_number().over(part)).drop("_part"))
    first = rows.filter(F.col("_nth") <= keep).withColumn("copy", F.least(
        F.row_number().over(Window.partitionBy(*within, "vid").orderBy("idx")), F.lit(keep + 1)))
    later = rows.filter(F.col("_nth") > keep).withColumn("copy", F.lit(keep + 1))
    return checkpoint(first.unionByName(later).drop("_nth"))


def nearest(vectors: DataFrame, k: int, block: Sequence[str] = (), carried: Sequence[str] = (),
            floor: float = 0.0, tile_rows: int = TILE_ROWS) -> DataFrame:
    """k nearest neighbours by cosine inside each block, self excluded by id.

    ``vectors`` has ``(idx, embedding, *block, *carried)`` with unit (or zero) vectors.
    Returns ``(*block, i, j, cos, *carried_i, *carried_j)``; ties go to the smaller id.
    ``floor`` drops neighbours below a similarity, which commutes with the limit.
    """
    if block:
        return nearest_of_copies(ranked_copies(vectors, k + 1, block), k, block, carried, floor, tile_rows)
    rows = ranked_copies(vectors, k + 1).withColumn("_all", F.lit(0))
    return nearest_of_copies(rows, k, ["_all"], carried, floor, tile_rows).drop("_all")


def knn_reach(index, inside: DataFrame, k: int, floor: float) -> DataFrame:
    """``(tile, own)``: the distance within which the ``k`` most similar rows of each row of a tile lie.

    ``inside`` has the neighbours in the own tile.  A similarity of 0 or less says nothing about the distance.
    """
    worst = inside.groupBy("vid").agg(F.count("*").alias("n"), F.min("cos").alias("cos"))
    known = F.when(F.col("n") >= k, F.greatest("cos", F.lit(floor))).otherwise(F.lit(floor))
    queries = index.rows.filter((F.col("tile") > 0) & (F.col("idx") == F.col("vid"))).select("tile", "vid")
    least = queries.join(worst, "vid", "left").groupBy("tile").agg(F.min(F.coalesce(known, F.lit(floor))).alias("cos"))
    own = F.when(F.col("cos") > 0, F.sqrt(F.greatest(2.0 - 2.0 * (F.col("cos") - 1e-8), F.lit(0.0)))).otherwise(float("inf"))
    reach = least.select("tile", own.alias("own"))
    return index.tiles.select("tile").join(reach, "tile", "left").select("tile", F.coalesce("own", F.lit(0.0)).alias("own"))


def radius_pairs(df: DataFrame, block: Sequence[str], row_id: str, tile_rows: int, reach: float) -> DataFrame:
    """:func:`tile_pairs` without the pairs of tiles that have no rows within ``reach`` of each other."""
    index = tile_index(df, block, row_id, tile_rows)
    return tile_pairs(df, block, row_id, tile_rows) if index is None else index.dealt(index.pairs(F.lit(reach)))


def nearest_of_copies(rows: DataFrame, k: int, block: Sequence[str], carried: Sequence[str], floor: float,
                      tile_rows: int = TILE_ROWS) -> DataFrame:
    """:func:`nearest` for rows that carry ``vid`` and ``copy``."""
    block = list(block)
    # nobody can have more than the first k + 1 of a set of copies among its neighbours
    candidates = rows.filter(F.col("copy") <= k + 1).drop("copy")
    fields = {f.name: f.dataType.simpleString() for f in candidates.schema}
    schema = ", ".join([f"{b} {fields[b]}" for b in block] + ["vid long", "j long", "cos double"]
                       + [f"{c}_j {fields[c]}" for c in carried])
    kernel = _knn_kernel(block, carried, k + 1, floor)
    index = tile_index(candidates, block, "idx", tile_rows)
    if index is None:
        partial = tile_pairs(candidates, block, "idx", tile_rows).groupBy(*block, "ta", "tb").applyInArrow(kernel, schema)
    else:
        # every tile with itself first: the worst of the best k + 1 bounds how far the others have to be looked for
        alone = index.rows.withColumn("ta", F.col("tile")).withColumn("tb", F.col("tile"))
        inside = checkpoint(alone.groupBy(*block, "ta", "tb").applyInArrow(kernel, schema))
        pairs = index.pairs(F.greatest("own", "other_own"), knn_reach(index, inside, k + 1, floor)).filter("ta < tb")
        partial = inside.unionByName(index.dealt(pairs, own=False).groupBy(*block, "ta", "tb").applyInArrow(kernel, schema))
    ranked = Window.partitionBy(*block, "vid").orderBy(F.desc("cos"), "j")
    found = partial.withColumn("_rank", F.row_number().over(ranked)).filter(F.col("_rank") <= k + 1)
    # at most k + 1 entries per vector
    entry = F.struct("_rank", "j", "cos", *[f"{c}_j" for c in carried])
    lists = found.groupBy(*block, "vid").agg(F.sort_array(F.collect_list(entry)).alias("_near"))
    own = rows.select(*block, F.col("idx").alias("i"), "vid", *[F.col(c).alias(f"{c}_i") for c in carried])
    return (own.join(lists, [*block, "vid"])
            .withColumn("_n", F.explode(F.slice(F.filter("_near", lambda n: n["j"] != F.col("i")), 1, k)))
            .select(*block, "i", "_n.j", "_n.cos", *[f"{c}_i" for c in carried], *[f"_n.{c}_j" for c in carried]))


# --- radius joins ------------------------------------------------------------------


def _within(left: np.ndarray, right: np.ndarray, limit: float, cosine: bool) -> np.ndarray:
    dots = left @ right.T
    if cosine:
        return 1.0 - dots < limit
    square = (left * left).sum(1)[:, None] + (right * right).sum(1)[None, :] - 2.0 * dots
    return np.sqrt(np.maximum(square, 0.0)) <= limit


def _sides(table: pa.Table):
    tile = table.column("tile").to_numpy()
    ta, tb = table.column("ta")[0].as_py(), table.column("tb")[0].as_py()
    rows = np.arange(table.num_rows)
    return rows[tile == ta], rows[tile == tb], ta == tb


def _degree_kernel(block: Sequence[str], limit: float, cosine: bool):
    """Per tile pair: how many rows (copies counted) lie in reach of each vector."""

    def kernel(table: pa.Table) -> pa.Table:
        left, right, same = _sides(table)
        vec, copies = matrix(table.column("embedding")), table.column("copies").to_numpy()
        degree = np.zeros(table.num_rows, dtype=np.int64)
        step = _chunk(len(right))
        for at in range(0, len(left), step):
            part = left[at:at + step]
            near = _within(vec[part], vec[right], limit, cosine)
            degree[part] += near @ copies[right]
            if not same:
                degree[right] += near.T @ copies[part]
        out = {name: table.column(name) for name in [*block, "vid"]}
        out["degree"] = pa.array(degree)
        return pa.table(out)

    return kernel


def _forest_kernel(limit: float, cosine: bool):
    """Per tile pair: a spanning forest of the in-reach pairs with a core end."""

    def kernel(table: pa.Table) -> pa.Table:
        left, right, _ = _sides(table)
        vec, vid = matrix(table.column("embedding")), table.column("vid").to_numpy()
        core = table.column("core").to_numpy(zero_copy_only=False).astype(bool)

        rows = np.arange(table.num_rows)
        roots = rows
        step = _chunk(len(right))
        for at in range(0, len(left), step):
            part = left[at:at + step]
            near = _within(vec[part], vec[right], limit, cosine)
            near &= core[part][:, None] | core[right][None, :]
            a, b = np.nonzero(near)
            roots = smallest_labels(table.num_rows, np.concatenate([rows, part[a]]), np.concatenate([roots, right[b]]))
        linked = roots != rows
        return pa.table({"src": vid[linked], "dst": vid[roots[linked]]})

    return kernel


def reach_links(vectors: DataFrame, limit: float, block: Sequence[str] = (), min_samples: int = 2,
                cosine: bool = False, tile_rows: int = TILE_ROWS):
    """Links that connect the rows in reach of a core row, plus the core table.

    Reach is a euclidean radius (inclusive), or a cosine distance (exclusive) with
    ``cosine``.  A row is core when at least ``min_samples`` rows, itself included,
    are in reach.  Returns ``(rows, links)``: ``rows`` is ``(*block, idx, vid, core)``
    and ``links`` is ``(src, dst)`` over ``vid``; a tile pair returns fewer links than rows.
    Below ``min_samples`` 3 ``core`` only tells of the row's copies: a linked row is core.
    """
    whole = not block
    block = list(block) or ["_all"]
    if whole:
        vectors = vectors.withColumn("_all", F.lit(0))
    reach = (2.0 * max(limit, 0.0)) ** 0.5 if cosine else limit
    keys = [*block, "embedding"]
    distinct = checkpoint(vectors.groupBy(*keys).agg(F.min("idx").alias("vid"), F.count("*").alias("copies")))
    rows = vectors.join(distinct, keys).select(*block, "idx", "vid", "copies")
    if min_samples <= 2:
        # any link makes both its ends core, so one pass is enough
        rows = rows.withColumn("core", F.col("copies") >= min_samples)
        active = distinct.withColumn("core", F.lit(True))
    else:
        fields = {f.name: f.dataType.simpleString() for f in distinct.schema}
        schema = ", ".join([f"{b} {fields[b]}" for b in block] + ["vid long", "degree long"])
        degrees = (radius_pairs(distinct, block, "vid", tile_rows, reach).groupBy(*block, "ta", "tb")
                   .applyInArrow(_degree_kernel(block, limit, cosine), schema)
                   .groupBy("vid").agg(F.sum("degree").alias("degree")))
        degrees = checkpoint(degrees)
        core = F.col("degree") >= min_samples
        rows = rows.join(degrees, "vid").withColumn("core", core).drop("degree")
        # a row in reach of nothing but its copies takes no part in the second pass
        active = distinct.join(degrees, "vid").withColumn("core", core).filter(F.col("degree") > F.col("copies"))
    links = (radius_pairs(active, block, "vid", tile_rows, reach).groupBy(*block, "ta", "tb")
             .applyInArrow(_forest_kernel(limit, cosine), "src long, dst long"))
    rows = rows.drop("copies")
    return (rows.drop("_all") if whole else rows), links
