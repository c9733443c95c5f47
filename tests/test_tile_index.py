"""Tiles by distance to pivots: nothing is lost, and far pairs of tiles are not formed."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ionweave.operators.density import density_clusters
from ionweave.operators.tile_index import _rings, tile_index
from ionweave.operators.tiles import knn_reach, nearest, radius_pairs


def groups(n, each, dim, spread, seed):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(n, dim))
    x = np.repeat(centers / np.linalg.norm(centers, axis=1, keepdims=True), each, 0) + rng.normal(size=(n * each, dim)) * spread
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def frame(spark, x, blocks=None):
    rows = [(int(i), [float(v) for v in r], int(b)) for i, (r, b) in enumerate(zip(x, np.zeros(len(x)) if blocks is None else blocks))]
    return spark.createDataFrame(rows, "idx long, embedding array<double>, b int")


def test_rings_hold_at_most_a_tile_unless_one_step_does():
    counts = np.array([0, 3, 4, 0, 9, 1, 1, 25, 2])
    ring, rings = _rings(counts, 10)
    assert rings == [(1, 2, 1), (4, 5, 1), (6, 6, 1), (7, 7, 3), (8, 8, 1)]
    assert [int(ring[s]) for s in np.flatnonzero(counts)] == [0, 0, 1, 1, 2, 3, 4]


def test_few_pairs_are_formed_on_grouped_vectors_and_none_is_missing(spark):
    x = groups(40, 50, 8, 0.02, 1)
    df, reach = frame(spark, x), 0.25
    index = tile_index(df, ["b"], "idx", 60)
    tiles = index.tiles.count()
    assert index.rows.count() == len(x) and index.rows.filter("tile = 0").isEmpty()
    assert index.rows.groupBy("tile").count().agg(F.max("count")).first()[0] <= 90
    pairs = index.pairs(F.lit(reach)).toPandas()
    assert len(pairs) < tiles * (tiles + 1) / 2 / 5
    tile = dict(index.rows.select("idx", "tile").collect())
    formed = set(map(tuple, pairs.values.tolist()))
    dist = np.sqrt(np.maximum(2 - 2 * x @ x.T, 0))
    for i, j in zip(*np.nonzero(np.triu(dist <= reach, 1))):
        assert tuple(sorted((tile[int(i)], tile[int(j)]))) in formed
    dealt = radius_pairs(df, ["b"], "idx", 60, reach)
    assert dealt.count() < len(x) * tiles / 5


def test_neighbours_and_clusters_equal_plain_ones(spark):
    x = np.concatenate([groups(12, 30, 6, 0.03, 2), np.zeros((3, 6)), groups(1, 5, 6, 0.0, 3)])
    blocks = np.arange(len(x)) % 5 == 0
    got = nearest(frame(spark, x, blocks), 4, ["b"], tile_rows=40).toPandas()
    sims = np.round(np.maximum(x @ x.T, 0), 9)
    for i in range(len(x)):
        others = [j for j in range(len(x)) if j != i and blocks[j] == blocks[i]]
        want = sorted(others, key=lambda j: (-sims[i, j], j))[:4]
        assert sorted(got[got.i == i].j) == sorted(want)
    one = density_clusters(frame(spark, x), 0.2, 3, tile_rows=10_000).select("idx", "label")
    two = density_clusters(frame(spark, x), 0.2, 3, tile_rows=30).select("idx", "label")
    assert sorted(one.collect()) == sorted(two.collect())


def test_neighbours_bound_the_search(spark):
    x = groups(30, 40, 8, 0.01, 5)
    rows = frame(spark, x).withColumn("vid", F.col("idx"))
    index = tile_index(rows, ["b"], "idx", 50)
    tile = np.array([t for _, t in sorted(index.rows.select("idx", "tile").collect())])
    sims = x @ x.T
    inside = [(i, float(s)) for i in range(len(x)) for s in np.sort(sims[i][tile == tile[i]])[-4:]]
    pairs = index.pairs(F.greatest("own", "other_own"), knn_reach(index, spark.createDataFrame(inside, "vid long, cos double"), 4, 0.0)).count()
    assert pairs < index.tiles.count() ** 2 / 2 / 5


def test_small_blocks_need_no_index(spark):
    assert tile_index(frame(spark, groups(3, 4, 4, 0.1, 0)), ["b"], "idx", 50) is None
    assert tile_index(frame(spark, groups(3, 4, 4, 0.1, 0)).limit(0), ["b"], "idx", 50) is None


@pytest.mark.parametrize("same", [0.0, 1.0])
def test_rows_that_pivots_cannot_tell_apart_are_cut_by_hash(spark, same):
    index = tile_index(frame(spark, np.full((300, 3), same)), ["b"], "idx", 50)
    assert index.rows.select("tile").distinct().count() == 6
    assert index.pairs(F.lit(0.0)).count() == 21


def test_copies_of_a_row_stay_few_however_small_the_tiles(spark):
    from ionweave.operators.tile_index import MAX_TILES
    from ionweave.operators.tiles import radius_pairs, tile_pairs
    x = np.random.default_rng(5).standard_normal((1_500, 6))
    rows = frame(spark, x / np.linalg.norm(x, axis=1, keepdims=True)).withColumn("b", F.lit(0))
    assert tile_pairs(rows, ["b"], "idx", 2).count() <= MAX_TILES * 1_500
    assert radius_pairs(rows, ["b"], "idx", 2, 3.0).count() <= 6 * MAX_TILES * 1_500
    small = rows.filter("idx < 40")  # a block of up to that many tiles keeps the size asked for
    assert tile_pairs(small, ["b"], "idx", 2).agg(F.max("tb")).first()[0] == 19
