"""Condensed cluster trees of spanning trees too large for one task, for any minimum size.

A spanning tree is contracted level by level.  An edge of a level is a branch if both its ends have a lower edge; without
the branches, every remaining piece has one pair of nodes that are lowest to each other, and the other nodes of the piece
join that pair's group one by one, by rank, until the lowest branch that touches the piece.  These are absorbed together
(raking the leaves and compressing the chain they hang on), the piece becomes one node, and what lies above its branch is
left for the next level.  A level at least halves the branches, so there are at most as many levels as the number of rows has bits.

First the rank at which the group of a row reaches the minimum size is found this way.  An edge between two groups that have
reached it before joins two clusters; these edges cut the tree into one piece per leaf cluster.  For the selection by excess of
mass the tree of the pieces is contracted in the same way, with the sizes, the weights and the best selections
below carried along the chains as running values, and the choice is handed down again level by level.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionweave.operators.graph import connected_components
from ionweave.operators.scan import NEVER, Running, running
from ionweave.session import sorted_slices, written

#: A parent whose own weight falls short of its children's by no more than this share of it is kept, as at equality.
TIE = 1e-9


def weight(rank: Column) -> Column:
    """1 / distance of an edge."""
    return 1.0 / F.greatest(rank["w"], F.lit(1e-12))


def _ends(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("x").alias("node"), "r").unionByName(edges.select(F.col("y").alias("node"), "r"))


@dataclass
class Level:
    """What one level of contraction does.

    ``absorbed`` has ``(node, piece, r)``: the edge at which a node joins its piece's group (two nodes at the first edge).
    ``rest`` has the edges ``(x, y, r)`` of the next level, and ``closed`` the rank ``(piece, closed)`` of the branch that
    ends a piece's chain, if there is one.
    """

    absorbed: DataFrame
    rest: DataFrame
    closed: DataFrame


def contract(edges: DataFrame) -> Level:
    """One level over the forest ``(x, y, r)`` with distinct ranks ``r``."""
    low = _ends(edges).groupBy("node").agg(F.min("r").alias("low"))
    judged = (edges.join(low.withColumnsRenamed({"node": "x", "low": "low_x"}), "x")
              .join(low.withColumnsRenamed({"node": "y", "low": "low_y"}), "y"))
    judged = written(judged.withColumn("branch", (F.col("low_x") < F.col("r")) & (F.col("low_y") < F.col("r"))))
    parts = written(connected_components(judged.filter("not branch").select(F.col("x").alias("src"), F.col("y").alias("dst"))))
    closed = _ends(judged.filter("branch")).join(parts, "node").groupBy("component").agg(F.min("r").alias("closed"))
    leaves = judged.select(F.col("x").alias("node"), "r", (F.col("low_x") == F.col("r")).alias("leaf")).unionByName(
        judged.select(F.col("y").alias("node"), "r", (F.col("low_y") == F.col("r")).alias("leaf"))).filter("leaf")
    taken = leaves.join(parts, "node").join(closed, "component", "left").filter(F.col("closed").isNull() | (F.col("r") < F.col("closed")))
    names = taken.groupBy("component").agg(F.min("node").alias("piece"), F.first("closed").alias("closed"))
    absorbed = written(taken.select("component", "node", "r").join(names, "component").select("node", "piece", "r", "closed"))
    moved = absorbed.select("node", "piece")
    rest = edges.join(absorbed.select("r").distinct(), "r", "left_anti")
    for side in ("x", "y"):
        rest = (rest.join(moved.withColumnRenamed("node", side), side, "left")
                .withColumn(side, F.coalesce("piece", side)).drop("piece"))
    ends = absorbed.filter("closed is not null").select("piece", "closed").distinct()
    return Level(absorbed.drop("closed"), written(rest.select("x", "y", "r")), ends)


def reach_ranks(tree: DataFrame, min_size: int) -> DataFrame:
    """``(vertex, t)``: the rank at which the group of a row reaches ``min_size`` rows; rows that never do are left out.

    Between two groups that have reached it nothing more can happen, so their edges are dropped on the way.
    """
    edges = tree.select(F.col("a").alias("x"), F.col("b").alias("y"), F.struct("w", "a", "b").alias("r"))
    if min_size <= 2:
        return _ends(edges).groupBy(F.col("node").alias("vertex")).agg(F.min("r").alias("t"))
    edges = written(edges)
    where = _ends(edges).select(F.col("node").alias("vertex"), "node").distinct()
    sizes = written(where.select("node", F.lit(1).cast("long").alias("n")))
    where, found = written(where), None
    while not edges.isEmpty():
        level = contract(edges)
        members = level.absorbed.join(sizes, "node")
        steps = members.groupBy("piece", "r").agg(F.sum("n").cast("double").alias("more"))
        grown = running(sorted_slices(steps, "piece", "r"), "piece", [Running("size", "more")])
        pieces = written(grown.groupBy("piece").agg(F.min(F.when(F.col("size") >= min_size, F.col("r"))).alias("crossing"),
                                                       F.max("size").cast("long").alias("n")))
        told = (members.filter(F.col("n") < min_size).join(pieces.select("piece", "crossing"), "piece").filter("crossing is not null")
                .select("node", F.when(F.col("r") < F.col("crossing"), F.col("crossing")).otherwise(F.col("r")).alias("t")))
        told = written(where.join(told, "node").select("vertex", "t", "node"))
        found = told.drop("node") if found is None else found.unionByName(told.drop("node"))
        moved = level.absorbed.select("node", "piece")
        where = written(where.join(told.select("vertex"), "vertex", "left_anti").join(moved, "node", "left")
                           .select("vertex", F.coalesce("piece", "node").alias("node")))
        sizes = written(sizes.join(moved, "node", "left_anti").unionByName(pieces.select(F.col("piece").alias("node"), "n")))
        small = sizes.filter(F.col("n") < min_size).select("node")
        open_ = level.rest.join(small.withColumnsRenamed({"node": "x"}).withColumn("sx", F.lit(True)), "x", "left")
        open_ = open_.join(small.withColumnsRenamed({"node": "y"}).withColumn("sy", F.lit(True)), "y", "left")
        edges = written(open_.filter("sx or sy").select("x", "y", "r"))
    if found is None:
        return where.select("vertex", F.lit(None).cast(tree.select(F.struct("w", "a", "b")).schema[0].dataType).alias("t")).limit(0)
    return found


def _pieces(tree: DataFrame, min_size: int) -> tuple[DataFrame, DataFrame]:
    """Rows ``(vertex, t, piece)``, and the edges ``(x, y, r)`` that join two clusters, between pieces."""
    reached = written(reach_ranks(tree, min_size))
    rank = F.struct("w", "a", "b")
    judged = (tree.join(reached.withColumnsRenamed({"vertex": "a", "t": "ta"}), "a")
              .join(reached.withColumnsRenamed({"vertex": "b", "t": "tb"}), "b")
              .withColumn("joins", (F.col("ta") < rank) & (F.col("tb") < rank)))
    judged = written(judged)
    parts = connected_components(judged.filter("not joins").select(F.col("a").alias("src"), F.col("b").alias("dst")))
    parts = written(parts.select(F.col("node").alias("vertex"), F.col("component").alias("piece")))
    ends = parts.withColumnsRenamed({"vertex": "a", "piece": "x"}), parts.withColumnsRenamed({"vertex": "b", "piece": "y"})
    joins = judged.filter("joins").select("a", "b", rank.alias("r")).join(ends[0], "a").join(ends[1], "b")
    return written(reached.join(parts, "vertex")), written(joins.select("x", "y", "r"))


def _named(rows: DataFrame, cluster: str) -> DataFrame:
    """``(vertex, label)``: clusters named by their smallest row."""
    names = rows.groupBy(cluster).agg(F.min("vertex").alias("label"))
    return rows.join(names, cluster).select("vertex", "label")


def _cluster(level: int, piece: str, k: Column) -> Column:
    return F.struct(F.lit(level).alias("level"), F.col(piece).alias("piece"), k.cast("long").alias("k"))


def _kept(own: Column, below: Column) -> Column:
    return own >= below - TIE * F.greatest(F.abs(own), F.abs(below))


@dataclass
class _Chain:
    """A level's own clusters: ``steps`` ``(piece, r, k, closes, keep)`` say at which edge cluster ``k`` - 1 of a piece closed
    and whether it is kept; ``taken`` has ``(node, piece, k, cluster, keep)`` for the nodes absorbed, with their own
    cluster, and ``events`` ``(t, piece, k)`` the rows that joined cluster ``k``."""

    steps: DataFrame
    taken: DataFrame
    events: DataFrame


def _climb(nodes: DataFrame, events: DataFrame, edges: DataFrame, number: int):
    """One level of the clusters' tree.

    ``nodes`` has ``(node, cluster, size, total, below)``: the open cluster of a node, its rows, the sum of their weights and
    the best selection below.  ``events`` has ``(node, t, n)``: rows that join whatever cluster holds the node at ``t``.
    """
    level = contract(edges)
    closing = level.absorbed.join(nodes, "node").withColumn("own", F.col("total") - weight(F.col("r")) * F.col("size"))
    closing = closing.withColumn("keep", _kept(F.col("own"), F.col("below")))
    closing = written(closing.withColumn("worth", F.when(F.col("keep"), F.col("own")).otherwise(F.col("below"))))
    at_edges = closing.groupBy("piece", "r").agg(F.sum("size").alias("more"), F.sum("worth").alias("more_worth"), F.lit(1.0).alias("edge"))
    pending = events.join(level.absorbed.select("node", "piece"), "node").join(level.closed, "piece", "left")
    now = pending.filter(F.col("closed").isNull() | (F.col("t") < F.col("closed"))).select("piece", "t", "n")
    extra = now.select("piece", F.col("t").alias("r"), F.col("n").cast("double").alias("more"), F.lit(0.0).alias("more_worth"), F.lit(0.0).alias("edge"))
    slices = sorted_slices(at_edges.unionByName(extra), "piece", "r")
    sized = running(slices, "piece", [Running("size", "more"), Running("k", "edge")])
    lam, edge = weight(F.col("r")), F.col("edge") > 0
    sized = (sized.withColumn("open_total", F.when(edge, lam * F.col("size")).otherwise(NEVER))
             .withColumn("add_total", F.when(edge, F.lit(NEVER)).otherwise(lam * F.col("more"))))
    total = running(sized, "piece", [Running("total", "add_total", "open_total")])
    own = F.when(edge & (F.col("k") > 1), F.col("total_before") - lam * F.col("size_before")).otherwise(NEVER)
    total = total.withColumn("own", own).withColumn("least", F.col("own") + F.col("more_worth"))
    steps = written(running(total, "piece", [Running("below", "more_worth", "least")]))
    last = F.max_by(F.struct("size", "total", "below", "k"), F.struct("r"))
    tops = steps.groupBy("piece").agg(last.alias("s")).select(
        F.col("piece").alias("node"), _cluster(number, "piece", F.col("s.k")).alias("cluster"), "s.size", "s.total", "s.below")
    judged = steps.filter(edge).select("piece", "r", F.col("k").cast("long").alias("k"), (F.col("k") > 1).alias("closes"),
                                       _kept(F.col("own"), F.col("below_before")).alias("keep"))
    taken = closing.select("node", "piece", "r", "cluster", "keep").join(judged.select("piece", "r", "k"), ["piece", "r"])
    done = steps.filter(~edge).select(F.col("r").alias("t"), "piece", F.col("k").cast("long").alias("k"))
    chain = _Chain(judged, taken.select("node", "piece", "k", "cluster", "keep"), done)
    moved = level.absorbed.select("node", "piece")
    left = events.join(moved, "node", "left").withColumn("node", F.coalesce("piece", "node")).drop("piece")
    left = written(left.join(now.select("t"), "t", "left_anti"))
    nodes = written(nodes.join(moved, "node", "left_anti").unionByName(tops))
    return chain, nodes, left, level.rest


def mass_clusters(tree: DataFrame, min_size: int) -> DataFrame:
    """Clusters by excess of mass from spanning-tree edges, as ``(vertex, label)``; the top cluster is not selected."""
    rows, edges = _pieces(tree, max(2, min_size))
    closed = _ends(edges).groupBy(F.col("node").alias("piece")).agg(F.min("r").alias("closed"))
    rows = written(rows.join(closed, "piece", "left").withColumn("inside", F.col("closed").isNull() | (F.col("t") < F.col("closed"))))
    leaves = rows.filter("inside").groupBy("piece").agg(F.count("*").cast("double").alias("size"), F.sum(weight(F.col("t"))).alias("total"))
    nodes = written(leaves.select(F.col("piece").alias("node"), _cluster(0, "piece", F.lit(0)).alias("cluster"), "size", "total", F.lit(0.0).alias("below")))
    events = written(rows.filter("not inside").groupBy(F.col("piece").alias("node"), "t").agg(F.count("*").alias("n")))
    chains = []
    while not edges.isEmpty():
        chain, nodes, events, edges = _climb(nodes, events, edges, len(chains) + 1)
        chains.append(chain)
    # downwards: ``chosen`` is the selected cluster that a node's open cluster lies in
    chosen = nodes.select("node", F.lit(None).cast(nodes.schema["cluster"].dataType).alias("chosen"))
    late = None
    for number in range(len(chains), 0, -1):
        chain = chains[number - 1]
        above = chosen.select(F.col("node").alias("piece"), "chosen")
        best = chain.steps.filter("closes and keep").groupBy("piece").agg(F.max(F.col("k") - 1).alias("best"))
        own = chain.steps.select("piece").distinct().join(above, "piece").join(best, "piece", "left")

        def choice(k: str) -> Column:
            return F.coalesce("chosen", F.when(F.col(k) <= F.col("best"), _cluster(number, "piece", F.col("best"))))

        taken = chain.taken.join(own, "piece").select(
            "node", F.coalesce(choice("k"), F.when(F.col("keep"), F.col("cluster"))).alias("chosen"))
        met = chain.events.join(own, "piece").select("t", choice("k").alias("chosen")).filter("chosen is not null")
        late = met if late is None else late.unionByName(met)
        chosen = written(chosen.join(chain.steps.select(F.col("piece").alias("node")), "node", "left_anti").unionByName(taken))
    inside = rows.filter("inside").join(chosen.filter("chosen is not null").withColumnRenamed("node", "piece"), "piece").select("vertex", "chosen")
    if late is not None:
        inside = inside.unionByName(rows.filter("not inside").join(late, "t").select("vertex", "chosen"))
    return _named(inside, "chosen")


def leaf_clusters(tree: DataFrame, min_size: int = 2) -> DataFrame:
    """Leaf clusters from spanning-tree edges, as ``(vertex, label)``.

    A piece between the joining edges holds one leaf cluster, which the lowest joining edge that touches it closes; a
    row whose group is large enough only later is noise.  A piece that no joining edge touches is the whole tree and is not selected.
    """
    rows, edges = _pieces(tree, max(2, min_size))
    closed = _ends(edges).groupBy(F.col("node").alias("piece")).agg(F.min("r").alias("closed"))
    return _named(rows.join(closed, "piece").filter(F.col("t") < F.col("closed")).select("vertex", "piece"), "piece")
