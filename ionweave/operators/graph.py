"""Graph operators over edge tables."""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionweave.session import written

#: At most this many links are finished in one task; more are handled by the rounds.
FINISH_LINKS = 1_000_000
CONTRACT_LINKS = 500_000


def symmetric(edges: DataFrame) -> DataFrame:
    """(w_ij + w_ji) / 2 with a missing direction counting as zero."""
    back = edges.select(F.col("j").alias("i"), F.col("i").alias("j"), "w")
    return edges.select("i", "j", "w").unionByName(back).groupBy("i", "j").agg((F.sum("w") / 2.0).alias("w"))


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy("i").agg(F.sum("w").alias("degree"))


def smallest_labels(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For ``n`` items and links ``u - v`` between them, the smallest item that each is connected with."""
    labels = np.arange(n)
    while len(u):
        a, b = labels[u], labels[v]
        apart = a != b
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while True:
            jumped = labels[labels]
            if np.array_equal(jumped, labels):
                break
            labels = jumped
    return labels


def _contract(limit: int):
    """Replace the links of a task by a star per connected piece, ``limit`` links at a time."""

    def stars(held):
        u, v = (np.concatenate(x) for x in zip(*held))
        items, place = np.unique(np.concatenate([u, v]), return_inverse=True)
        labels = smallest_labels(len(items), place[:len(u)], place[len(u):])
        member = np.flatnonzero(labels != np.arange(len(items)))
        return pa.RecordBatch.from_pydict({"u": pa.array(items[member]), "v": pa.array(items[labels[member]])})

    def run(batches: Iterator[pa.RecordBatch]):
        held, seen = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(tuple(batch.column(n).to_numpy(zero_copy_only=False) for n in ("u", "v")))
                seen += batch.num_rows
            if seen >= limit:
                yield stars(held)
                held, seen = [], 0
        if held:
            yield stars(held)

    return run


def _lower(links: DataFrame) -> DataFrame:
    """Distinct links as (u, v) with u above v."""
    return (links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
            .filter(F.col("u") != F.col("v")).distinct())


def connected_components(links: DataFrame, finish_links: int = FINISH_LINKS) -> DataFrame:
    """``(node, component)`` for the linked nodes; a component is named by its smallest node.

    ``links`` has ``(src, dst)``.  Tasks first contract their own share of the links.
    A remainder of proven small size is then finished in one task; a larger one goes
    through alternating rounds that attach the larger, then the smaller neighbours of a
    node to the smallest one (large-star and small-star, Kiveris et al. 2014).  Each
    round is written as a table.
    """
    pairs = links.select(F.col("src").cast("bigint").alias("u"), F.col("dst").cast("bigint").alias("v"))
    state = written(_lower(pairs.filter("u <> v")).mapInArrow(_contract(CONTRACT_LINKS), "u long, v long"))
    if state.limit(finish_links + 1).count() <= finish_links:
        stars = state.coalesce(1).mapInArrow(_contract(finish_links + 1), "u long, v long")
    else:
        before = None
        while True:
            both = state.union(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
            low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
            large = (both.filter(F.col("v") > F.col("u")).join(low, "u")
                     .select(F.col("v").alias("u"), F.col("m").alias("v")))
            large = written(_lower(large))
            low = large.groupBy("u").agg(F.min("v").alias("m"))
            small = (large.join(low, "u").select("v", "m").filter("v <> m")
                     .select(F.col("v").alias("u"), F.col("m").alias("v"))
                     .union(low.select("u", F.col("m").alias("v"))))
            state = written(_lower(small))
            sign = state.agg(F.count("*").alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("s"),
                             F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
            if sign == before:
                break
            before = sign
        stars = state
    members = stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.union(stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
