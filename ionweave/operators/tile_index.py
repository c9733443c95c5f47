"""Tiles that follow the metric, so that far pairs of tiles need not be formed.

Pivots of bounded number are spread over the large blocks.  A row belongs to its nearest pivot, and the rows of a pivot are
cut by their distance to it into rings of at most a tile's rows.  By the triangle inequality two rings bound from below
every distance between their rows; a pair of tiles is formed only if that bound is in reach.  Nothing is lost: pivots come
from a sample, but every row and every pair of rings is judged.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Iterator, Optional, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionweave.session import checkpoint, small_rows

#: Pivots over all large blocks, and steps of distance that rings are cut at: both bound what the driver sees.
PIVOTS, STEPS = 256, 512
SAMPLE_PER_PIVOT = 16
#: A block is cut into about this many tiles at most while its tiles hold no more than ``WIDE_ROWS`` rows, whatever tile size is
#: asked for.  A row travels once per tile of its block, so what is shuffled then grows like the rows and not like their square.
MAX_TILES, WIDE_ROWS = 32, 16_384
#: Rounding of distances and of similarities (to 9 digits) never decides whether a pair is formed.
MARGIN = 1e-6


def tile_size(rows: Column, tile_rows: int, widest: int = WIDE_ROWS) -> Column:
    """Rows per tile of a block of ``rows`` rows."""
    return F.greatest(F.lit(tile_rows), F.least(F.lit(widest), F.ceil(rows / MAX_TILES))).cast("int")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (rows * rows).sum(1)[:, None] + (pivots * pivots).sum(1)[None] - 2.0 * rows @ pivots.T
    return np.sqrt(np.maximum(square, 0.0))


def _spread(sample: np.ndarray, count: int) -> np.ndarray:
    """Up to ``count`` rows, each the farthest from those before it."""
    chosen = [0]
    gap = _distances(sample, sample[:1])[:, 0]
    while len(chosen) < count and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, _distances(sample, sample[chosen[-1]:chosen[-1] + 1])[:, 0])
    return sample[chosen]


def _rings(counts: np.ndarray, tile_rows: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Ring per step for the rows of one pivot, and ``(first step, last step, tiles)`` per ring."""
    ring, rings, held = np.zeros(len(counts), np.int64), [], 0
    for step in np.flatnonzero(counts):
        if rings and held + counts[step] <= tile_rows:
            held += int(counts[step])
            rings[-1] = (rings[-1][0], int(step), 1)
        else:
            held = int(counts[step])
            rings.append((int(step), int(step), -(-held // tile_rows)))
        ring[step] = len(rings) - 1
    return ring, rings


@dataclass
class TileIndex:
    """``rows`` are the given ones with ``tile``; ``tiles`` has ``(tile, pivot, lo, hi)`` for the tiles of large blocks, and
    ``near`` the pairs of pivots ``(pivot, other, gap)`` of a block, in both orders and with themselves."""

    rows: DataFrame
    tiles: DataFrame
    near: DataFrame

    def pairs(self, reach: Column, bounds: Optional[DataFrame] = None) -> DataFrame:
        """``(ta, tb)``, ``ta`` <= ``tb``, of the tiles that may hold rows within ``reach``.

        ``bounds`` gives tiles a column ``(tile, own)`` that ``reach`` may use as ``own`` and ``other_own``.
        """
        tiles = self.tiles if bounds is None else self.tiles.join(bounds, "tile")
        names = {name: name if name in ("tile", "pivot") else f"other_{name}" for name in tiles.columns}
        others = tiles.select(*[F.col(a).alias(b) for a, b in names.items()]).withColumnsRenamed({"tile": "other_tile", "pivot": "other"})
        both = tiles.join(self.near, "pivot").join(others, "other").filter("tile <= other_tile")
        bound = F.greatest(F.col("gap") - F.col("hi") - F.col("other_hi"), F.col("lo") - F.col("gap") - F.col("other_hi"),
                           F.col("other_lo") - F.col("gap") - F.col("hi"))
        kept = both.filter((F.col("tile") == F.col("other_tile")) | (bound <= reach + MARGIN))
        return kept.select(F.col("tile").alias("ta"), F.col("other_tile").alias("tb"))

    def dealt(self, pairs: DataFrame, own: bool = True) -> DataFrame:
        """Rows with ``ta`` and ``tb``, once for every pair of their tile; with ``own``, rows of small blocks too."""
        sides = pairs.select(F.col("ta").alias("tile"), "ta", "tb").unionByName(
            pairs.filter("ta < tb").select(F.col("tb").alias("tile"), "ta", "tb"))
        out = self.rows.join(sides, "tile")
        return out.unionByName(self.rows.filter("tile = 0").withColumn("ta", F.col("tile")).withColumn("tb", F.col("tile"))) if own else out


def tile_index(df: DataFrame, block: Sequence[str], row_id: str, tile_rows: int) -> Optional[TileIndex]:
    """The index of rows ``(*block, row_id, embedding, …)``; None if no block is larger than a tile, or too many are."""
    block, spark = list(block), df.sparkSession
    hot = (df.groupBy(*block).agg(F.count("*").alias("_rows")).filter(F.col("_rows") > tile_rows)
           .withColumn("_size", tile_size(F.col("_rows"), tile_rows)))
    n_hot, local = small_rows(hot, PIVOTS)
    if local is None:
        return None
    share = max(1, PIVOTS // n_hot)
    wanted = F.least(F.lit(share), F.ceil(2 * F.col("_rows") / F.col("_size")))
    draw = F.pmod(F.xxhash64(F.lit("pivot"), row_id), F.lit(1 << 20)) / float(1 << 20)
    sample = (df.join(F.broadcast(local.withColumn("_wanted", wanted)), block)
              .filter(draw * F.col("_rows") < SAMPLE_PER_PIVOT * F.col("_wanted"))
              .select(*block, "_wanted", row_id, "embedding").limit(4 * SAMPLE_PER_PIVOT * PIVOTS).collect())
    groups: dict[tuple, list] = {}
    for row in sorted(sample, key=lambda r: r[row_id]):
        groups.setdefault(tuple(row[b] for b in block), []).append(row)
    pivots, table, sizes = [], [], []
    for row in local.collect():
        key = tuple(row[b] for b in block)
        found = groups.get(key)
        if found is None:  # an unlucky draw: all rows of the block are near the origin's pivot
            chosen = np.zeros((1, len(sample[0]["embedding"]) if sample else 1))
        else:
            chosen = _spread(np.array([r["embedding"] for r in found], float), int(found[0]["_wanted"]))
        table.append((*key, len(pivots), len(pivots) + len(chosen)))
        pivots.extend(chosen)
        sizes += [row["_size"]] * len(chosen)
    if len({len(p) for p in pivots}) > 1:
        return None
    pivots = np.array(pivots, float)
    fields = [f.simpleString() for f in df.select(*block).schema.fields]
    ranges = spark.createDataFrame(table, ", ".join([f.replace(":", " ", 1) for f in fields] + ["_from long", "_to long"]))
    placed = checkpoint(df.join(F.broadcast(ranges), block, "left").withColumn("_from", F.coalesce("_from", F.lit(-1))))
    columns = df.columns

    def places(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Nearest pivot (-1: small block) and the distance to it."""
        start = batch.column("_from").to_numpy()
        nearest, distance = np.full(len(start), -1), np.zeros(len(start))
        ends = batch.column("_to").fill_null(-1).to_numpy()
        for first in np.unique(start[start >= 0]):
            at = np.flatnonzero(start == first)
            far = _distances(_matrix(batch.column("embedding").take(pa.array(at))), pivots[first:ends[at[0]]])
            pick = far.argmin(1)
            nearest[at], distance[at] = pick + first, far[np.arange(len(at)), pick]
        return nearest, distance

    def largest(batches: Iterator[pa.RecordBatch]):
        yield pa.RecordBatch.from_pydict({"d": [max((float(places(b)[1].max(initial=0.0)) for b in batches), default=0.0)]})

    width = max(placed.mapInArrow(largest, "d double").agg(F.max("d")).first()[0] or 0.0, 1e-9) * (1 + 1e-9) / STEPS

    def tally(batches: Iterator[pa.RecordBatch]):
        total = np.zeros((len(pivots), STEPS + 1), np.int64)
        for batch in batches:
            near, far = places(batch)
            here = near >= 0
            np.add.at(total, (near[here], (far[here] / width).astype(np.int64)), 1)
        p, s = np.nonzero(total)
        yield pa.RecordBatch.from_pydict({"p": pa.array(p, pa.int64()), "s": pa.array(s, pa.int64()), "n": pa.array(total[p, s], pa.int64())})

    counts = np.zeros((len(pivots), STEPS + 1), np.int64)
    for row in placed.mapInArrow(tally, "p long, s long, n long").groupBy("p", "s").agg(F.sum("n").alias("n")).collect():
        counts[row["p"], row["s"]] = row["n"]
    first_tile, parts, tiles = np.zeros((len(pivots), STEPS + 1), np.int64), np.ones((len(pivots), STEPS + 1), np.int64), []
    number = 1
    for p in range(len(pivots)):
        ring, rings = _rings(counts[p], sizes[p])
        base = []
        for lo, hi, n in rings:
            tiles.append((number, n, p, lo * width, (hi + 1) * width))
            base.append((number, n))
            number += n
        for s in np.flatnonzero(counts[p]):
            first_tile[p, s], parts[p, s] = base[ring[s]]

    def deal(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            near, far = places(batch)
            step = (far / width).astype(np.int64)
            tile = np.where(near >= 0, first_tile[near, step] + batch.column("_draw").to_numpy() % parts[near, step], 0)
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in columns], pa.array(tile, pa.int64())], names=[*columns, "tile"])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields], "tile long"])
    rows = checkpoint(placed.withColumn("_draw", F.pmod(F.xxhash64(row_id), F.lit(1 << 30))).mapInArrow(deal, schema))
    rings = spark.createDataFrame(tiles, "first long, n long, pivot long, lo double, hi double")
    tiles = rings.select(F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("tile"), "pivot", "lo", "hi")
    gaps = _distances(pivots, pivots)
    near = spark.createDataFrame([(p, q, float(gaps[p, q])) for *_, a, b in table for p in range(a, b) for q in range(a, b)], "pivot long, other long, gap double")
    return TileIndex(rows, tiles, near)
