"""Hierarchical density clustering (HDBSCAN) per block.

Edges are ranked by (distance, lower id, higher id), so the minimum spanning tree is
unique and every route below gives the same clusters.  A block of bounded size is done
in one task.  A larger one goes through tile pairs: the tree of a graph is contained in
the union of the trees of any cover of its edges, so the tile pairs return at most
two tiles' worth of edges each, and the rest is joins and aggregations.
"""

from __future__ import annotations

from typing import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ionweave.operators.condensed_tree import TIE, leaf_clusters, mass_clusters
from ionweave.operators.agreement import agreement_links
from ionweave.operators.graph import connected_components
from ionweave.operators.tiles import COSINE_DIGITS, matrix, tile_pairs
from ionweave.session import written

BLOCK_ROWS = 5_000
TREE_TILE_ROWS = 2_048
#: Rows of a tile in large blocks; a pair of such tiles is a task of some seconds.
WIDE_TREE_ROWS = 8_192


def spanning_tree(vec: np.ndarray, ids: np.ndarray, core: np.ndarray, side: np.ndarray = None):
    """Minimum spanning tree edges (a, b, w) by position; ``side`` allows only cross edges."""
    n = len(ids)
    square = (vec * vec).sum(1)
    best = np.full(n, np.inf)
    source = np.full(n, -1)
    inside = np.zeros(n, dtype=bool)
    edges = []
    at = int(np.argmin(ids))
    for _ in range(n - 1):
        inside[at] = True
        dist = np.sqrt(np.maximum(square + square[at] - 2.0 * (vec @ vec[at]), 0.0))
        dist = np.round(np.maximum(np.maximum(dist, core), core[at]), COSINE_DIGITS)
        if side is not None:
            dist[side == side[at]] = np.inf
        tied = (dist == best) & (source >= 0) & np.isfinite(dist)
        better = dist < best
        if tied.any():
            t = np.flatnonzero(tied)
            new = np.stack([np.minimum(ids[t], ids[at]), np.maximum(ids[t], ids[at])])
            old = np.stack([np.minimum(ids[t], ids[source[t]]), np.maximum(ids[t], ids[source[t]])])
            better[t] = (new[0] < old[0]) | ((new[0] == old[0]) & (new[1] < old[1]))
        better &= ~inside
        best[better], source[better] = dist[better], at
        open_ = np.where(inside, np.inf, best)
        low = open_.min()
        if not np.isfinite(low):
            break
        ties = np.flatnonzero(open_ == low)
        lo, hi = np.minimum(ids[ties], ids[source[ties]]), np.maximum(ids[ties], ids[source[ties]])
        at = int(ties[np.lexsort((hi, lo))[0]])
        edges.append((int(source[at]), at, float(low)))
    return edges


def core_distances(vec: np.ndarray, min_samples: int) -> np.ndarray:
    """Distance to the ``min_samples``-th nearest row, the row itself being the first."""
    if min_samples <= 1:
        return np.zeros(len(vec))
    k = min(min_samples, len(vec)) - 1
    square = (vec * vec).sum(1)
    dist = np.sqrt(np.maximum(square[:, None] + square[None, :] - 2.0 * vec @ vec.T, 0.0))
    np.fill_diagonal(dist, 0.0)
    return np.partition(dist, k, axis=1)[:, k]


def tree_clusters(n: int, edges, ids: np.ndarray, min_size: int, method: str = "leaf") -> np.ndarray:
    """Cluster number per row (-1 noise) from spanning-tree edges.

    Going up in distance, a piece that reaches ``min_size`` opens a cluster, smaller
    pieces joining it are its members, and two such pieces meeting close both and open
    their parent.  The top cluster itself is never selected.
    """
    ranked = sorted(edges, key=lambda e: (e[2], min(ids[e[0]], ids[e[1]]), max(ids[e[0]], ids[e[1]])))
    parent = list(range(n))
    piece = {i: [i] for i in range(n)}
    cluster_of: dict[int, int] = {}
    up, kids, members, weight_sum, size, birth = [], [], [], [], [], []

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def open_cluster(rows, lam, children):
        up.append(-1), kids.append(children), members.append(list(rows))
        weight_sum.append(lam * len(rows)), size.append(len(rows)), birth.append(0.0)
        for c in children:
            up[c], birth[c] = len(up) - 1, lam
        return len(up) - 1

    for a, b, w in ranked:
        a, b = root(a), root(b)
        lam = 1.0 / max(w, 1e-12)
        ca, cb = cluster_of.get(a), cluster_of.get(b)
        rows = piece[a] + piece[b] if len(piece[a]) >= len(piece[b]) else piece[b] + piece[a]
        if ca is not None and cb is not None:
            now = open_cluster([], lam, [ca, cb])
            size[now] = size[ca] + size[cb]
            weight_sum[now] = lam * size[now]
        elif ca is None and cb is None:
            now = open_cluster(rows, lam, []) if len(rows) >= min_size else None
        else:
            now, extra = (ca, piece[b]) if ca is not None else (cb, piece[a])
            members[now].extend(extra)
            weight_sum[now] += lam * len(extra)
            size[now] += len(extra)
        parent[b] = a
        piece[a], piece[b] = rows, []
        cluster_of.pop(b, None)
        if now is not None:
            cluster_of[a] = now

    labels = np.full(n, -1, dtype=np.int64)
    tops = [c for c in range(len(up)) if up[c] < 0]
    chosen = []
    if method == "leaf":
        chosen = [c for c in range(len(up)) if not kids[c] and c not in tops]
    else:
        worth = [0.0] * len(up)
        keep = [False] * len(up)
        for c in range(len(up)):  # children come before their parent
            own = weight_sum[c] - birth[c] * size[c]
            below = sum(worth[k] for k in kids[c])
            keep[c] = c not in tops and own >= below - TIE * max(abs(own), abs(below))
            worth[c] = own if keep[c] else below
        stack = list(tops)
        while stack:
            c = stack.pop()
            if keep[c]:
                chosen.append(c)
            else:
                stack.extend(kids[c])
    for c in chosen:
        stack = [c]
        while stack:
            x = stack.pop()
            labels[members[x]] = c
            stack.extend(kids[x])
    return labels


def _block_kernel(min_size: int, min_samples: int, method: str):
    def kernel(table: pa.Table) -> pa.Table:
        vec, ids = matrix(table.column("embedding")), table.column("vertex").to_numpy()
        if len(ids) < max(2, min_size):
            labels = np.full(len(ids), -1)
        else:
            labels = tree_clusters(len(ids), spanning_tree(vec, ids, core_distances(vec, min_samples)),
                                   ids, min_size, method)
        names = ids.copy()
        for c in np.unique(labels):
            names[labels == c] = -1 if c < 0 else ids[labels == c].min()
        return pa.table({"vertex": ids, "label": names})

    return kernel


def _tree_kernel():
    def kernel(table: pa.Table) -> pa.Table:
        ids, tile = table.column("vertex").to_numpy(), table.column("tile").to_numpy()
        same = table.column("ta")[0].as_py() == table.column("tb")[0].as_py()
        edges = spanning_tree(matrix(table.column("embedding")), ids, table.column("core").to_numpy(),
                              None if same else tile)
        a = ids[[e[0] for e in edges]] if edges else np.zeros(0, np.int64)
        b = ids[[e[1] for e in edges]] if edges else np.zeros(0, np.int64)
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b),
                         "w": np.array([e[2] for e in edges], dtype=float)})

    return kernel


def distributed_tree(rows: DataFrame, block: Sequence[str], min_samples: int = 1,
                     tile_rows: int = TREE_TILE_ROWS) -> DataFrame:
    """Minimum spanning forest ``(a, b, w)`` with one tree per block of ``(*block, vertex, embedding)``."""
    block = list(block)
    if min_samples <= 1:
        # copies hang on the first of them at distance zero, which is also what the ranking picks
        keys = [*block, "embedding"]
        firsts = rows.groupBy(*keys).agg(F.min("vertex").alias("first"))
        stars = (rows.join(firsts, keys).filter("vertex <> first")
                 .select(F.col("first").alias("a"), F.col("vertex").alias("b"), F.lit(0.0).alias("w")))
        points = firsts.select(*keys, F.col("first").alias("vertex"), F.lit(0.0).alias("core"))
    else:
        points = rows.join(_core_table(rows, block, min_samples, tile_rows), "vertex")
        stars = None
    found = (tile_pairs(points, block, "vertex", tile_rows, WIDE_TREE_ROWS).groupBy(*block, "ta", "tb")
             .applyInArrow(_tree_kernel(), "a long, b long, w double"))
    pool = written(found.withColumn("ca", F.col("a")).withColumn("cb", F.col("b")))
    tree = None
    while True:
        both = pool.select("ca", "w", "a", "b").union(pool.select(F.col("cb"), "w", "a", "b"))
        picked = written(both.groupBy("ca").agg(F.min(F.struct("w", "a", "b")).alias("e"))
                            .select("e.w", "e.a", "e.b").distinct())
        if picked.isEmpty():
            break
        tree = picked if tree is None else tree.union(picked)
        ends = pool.join(picked, ["w", "a", "b"], "left_semi")
        parts = connected_components(ends.select(F.col("ca").alias("src"), F.col("cb").alias("dst")))
        parts = parts.select("node", "component")
        pool = (pool.join(parts.select(F.col("node").alias("ca"), F.col("component").alias("na")), "ca")
                .join(parts.select(F.col("node").alias("cb"), F.col("component").alias("nb")), "cb")
                .filter("na <> nb").select("a", "b", "w", F.col("na").alias("ca"), F.col("nb").alias("cb")))
        pool = written(pool)
    edges = found.limit(0) if tree is None else tree.select("a", "b", "w")
    return edges if stars is None else edges.unionByName(stars)


def _core_kernel(k: int):
    def kernel(table: pa.Table) -> pa.Table:
        ids, tile = table.column("vertex").to_numpy(), table.column("tile").to_numpy()
        ta, tb = table.column("ta")[0].as_py(), table.column("tb")[0].as_py()
        vec = matrix(table.column("embedding"))
        rows = np.arange(len(ids))
        out_id, out_d = [], []
        for x, y in [(ta, tb)] if ta == tb else [(ta, tb), (tb, ta)]:
            left, right = rows[tile == x], rows[tile == y]
            if len(left) == 0 or len(right) == 0:
                continue
            square = (vec * vec).sum(1)
            dist = np.sqrt(np.maximum(square[left][:, None] + square[right][None] - 2 * vec[left] @ vec[right].T, 0))
            if x == y:
                np.fill_diagonal(dist, 0.0)
            keep = min(k, dist.shape[1])
            near = np.partition(dist, keep - 1, axis=1)[:, :keep]
            out_id.append(np.repeat(ids[left], keep))
            out_d.append(near.ravel())
        return pa.table({"vertex": np.concatenate(out_id) if out_id else np.zeros(0, np.int64),
                         "d": np.concatenate(out_d) if out_d else np.zeros(0)})

    return kernel


def _core_table(rows: DataFrame, block: Sequence[str], k: int, tile_rows: int) -> DataFrame:
    near = (tile_pairs(rows, block, "vertex", tile_rows, TREE_TILE_ROWS).groupBy(*block, "ta", "tb")
            .applyInArrow(_core_kernel(k), "vertex long, d double"))
    order = Window.partitionBy("vertex").orderBy("d")
    return (near.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k)
            .groupBy("vertex").agg(F.max("d").alias("core")))


def hdbscan_blocks(rows: DataFrame, block: Sequence[str], min_size: int = 2, min_samples: int = 1,
                   method: str = "leaf", block_rows: int = BLOCK_ROWS,
                   tile_rows: int = TREE_TILE_ROWS) -> DataFrame:
    """``(vertex, label)`` of rows ``(*block, vertex, embedding)``, clustered block by block.

    ``vertex`` is unique over all blocks; a cluster is named by its smallest vertex.
    """
    block = list(block)
    sizes = rows.groupBy(*block).agg(F.count("*").alias("_rows"))
    large = sizes.filter(F.col("_rows") > block_rows).select(*block)
    kernel = _block_kernel(min_size, min_samples, method)
    if large.isEmpty():
        return rows.groupBy(*block).applyInArrow(kernel, "vertex long, label long")
    small = rows.join(large, block, "left_anti").groupBy(*block).applyInArrow(kernel, "vertex long, label long")
    big = rows.join(large, block, "left_semi")
    tree = written(distributed_tree(big, block, min_samples, tile_rows))
    found = leaf_clusters(tree, min_size) if method == "leaf" else mass_clusters(tree, min_size)
    big = big.select("vertex").join(found, "vertex", "left").select(
        "vertex", F.coalesce("label", F.lit(-1).cast("bigint")).alias("label"))
    return small.unionByName(big)


def vote_components(parts: DataFrame, min_votes: int) -> DataFrame:
    """Components ``(node, component)`` of rows that share a part in at least ``min_votes`` repeats.

    ``parts`` has ``(idx, rep, part)``.  Parts of any size vote, and any number of repeats; see :mod:`ionweave.operators.agreement`.
    """
    return connected_components(agreement_links(parts, min_votes))


def votes_needed(setting, repeats: int) -> int:
    """Agreement needed: at least two when set, else a strict majority."""
    return max(2, setting) if setting is not None else max(1, repeats // 2 + 1)


def bucketed_hdbscan(coded: DataFrame, repeats: int, min_size: int = 2, min_samples: int = 1,
                     method: str = "leaf", min_votes: int = 2, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(idx, label)``: clusters per hash bucket and repeat, merged by votes.

    ``coded`` has ``(idx, embedding, codes)``.
    """
    rows = coded.select("idx", "embedding", F.posexplode("codes").alias("rep", "code")).withColumn(
        "vertex", F.col("idx") * repeats + F.col("rep"))
    found = hdbscan_blocks(rows.select("rep", "code", "vertex", "embedding"), ["rep", "code"],
                           min_size, min_samples, method, block_rows)
    parts = found.filter("label >= 0").select(
        F.floor(F.col("vertex") / repeats).alias("idx"), F.pmod("vertex", F.lit(repeats)).alias("rep"),
        F.col("label").alias("part"))
    linked = vote_components(parts, min_votes)
    sizes = linked.groupBy("component").agg(F.count("*").alias("_n")).filter(F.col("_n") >= min_size)
    kept = linked.join(sizes, "component").select(F.col("node").alias("idx"), F.col("component").alias("label"))
    return coded.select("idx").join(kept, "idx", "left").select(
        "idx", F.coalesce("label", F.lit(-1).cast("bigint")).alias("label"))
