"""SimHash near-dedup with bit-sliced comparison.

Fingerprints are compared inside blocks that agree on some of their bits.  The fingerprints of a block
are stored vertically, one bit plane after the other, so that one operation on a machine word works on
64 pairs.  Distances grow in carry-save counters, plane by plane, and a word is abandoned once its 64
pairs all exceed the radius.
"""

from __future__ import annotations

from itertools import combinations
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionweave.llm.common import spread_join, stored
from ionweave.operators.graph import connected_components, smallest_labels

#: Rows of a block that one task compares with as many others; larger blocks are cut into tiles.
TILE_ROWS = 4096
LANES = 65_536
#: Rows of a candidate group whose shingle sets one task compares with as many others.
SET_ROWS = 512
HOT_KEYS_TO_BROADCAST = 100_000
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


# --- fingerprints -------------------------------------------------------------------


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64, seed 42, of every run of ``words`` words, repeats included; A-Z is lowered, blanks are ASCII blanks."""
    import xxhash

    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII blanks only
    if not tokens:
        return np.empty(0, np.uint64)
    joined, count = b" ".join(tokens), max(1, len(tokens) - words + 1)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:count].tolist()
    stops = ends[len(tokens) - count:].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, stops)), np.uint64, count)


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """Further independent 64 bits from a hash: the finaliser of splitmix64 after ``k`` steps."""
    z = h + np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def simhash(hashes: np.ndarray, width: int) -> np.ndarray:
    """``width`` words of 64 bits; a bit is 1 if it is set in over half of the hashes."""
    ones = np.zeros(64 * width, np.int64)
    for at in range(0, len(hashes), 255 * 64):
        part = hashes[at:at + 255 * 64]
        table = np.stack([part if k == 0 else _mixed(part, k) for k in range(width)], axis=1)
        bits = np.unpackbits(table.view(np.uint8), axis=1, bitorder="little")
        for low in range(0, len(bits), 255):
            ones += bits[low:low + 255].sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)


def _names(width: int) -> list[str]:
    return [f"f{k}" for k in range(width)]


def fingerprints(docs: DataFrame, words: int = 3, width: int = 1, digests: bool = False) -> DataFrame:
    """``(doc_id, f0, ...)``: fingerprints as signed 64-bit words; a text without words has zeros.

    With ``digests`` also ``s0, s1``, the digest of :func:`shingle_set`.
    """
    names = _names(width) + ["s0", "s1"] * digests

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            rows = [simhash(shingle_hashes(t, words), width) for t in texts]
            table = np.array(rows, np.uint64).reshape(len(rows), width).view(np.int64)
            columns = [pa.array(table[:, k]) for k in range(width)]
            if digests:
                columns += [pa.array(x, pa.int64()) for x in zip(*(shingle_set(t, words)[1:] for t in texts))] or [pa.array([], pa.int64())] * 2
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", *names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, ", ".join([f"doc_id {kind}", *(f"{n} long" for n in names)]))


def shingle_set(text: str | None, words: int) -> tuple[np.ndarray, int, int]:
    """Distinct shingle hashes, sorted, and a digest of them in two signed words."""
    import xxhash

    own = np.unique(shingle_hashes(text, words))
    digest = xxhash.xxh128_intdigest(own.tobytes(), 42)
    return own, _signed(digest >> 64), _signed(digest & 0xFFFFFFFFFFFFFFFF)


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """``(s0, s1, shingles)`` per row: the digest of :func:`shingle_set` and the set as bytes."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            rows = [shingle_set(t, words) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[0].tobytes() for r in rows], pa.binary())],
                names=["s0", "s1", "shingles"])

    return docs.select("text").mapInArrow(run, "s0 long, s1 long, shingles binary")


# --- candidate blocks ---------------------------------------------------------------


def complete_masks(radius: int, parts: int, width: int = 1) -> list[list[int]]:
    """Bit masks such that fingerprints within ``radius`` agree on at least one: all choices of ``parts - radius`` of ``parts`` parts."""
    bits = 64 * width
    edges = [bits * k // parts for k in range(parts + 1)]
    out = []
    for chosen in combinations(range(parts), parts - radius):
        whole = sum(((1 << edges[k + 1]) - 1) ^ ((1 << edges[k]) - 1) for k in chosen)
        out.append([whole >> 64 * k & 0xFFFFFFFFFFFFFFFF for k in range(width)])
    return out


def sampled_masks(tables: int, bits: int, width: int, seed: int = 7) -> list[list[int]]:
    """``tables`` masks of ``bits`` bits each, drawn from the whole fingerprint with a fixed seed."""
    draw, out = np.random.Generator(np.random.PCG64(seed)), []
    for _ in range(tables):
        whole = sum(1 << int(b) for b in draw.choice(64 * width, bits, replace=False))
        out.append([whole >> 64 * k & 0xFFFFFFFFFFFFFFFF for k in range(width)])
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _block_keys(masks: list[list[int]]) -> Column:
    """One hash per mask; equal masked bits have equal hashes, and a chance collision costs a comparison only."""
    keys = []
    for t, mask in enumerate(masks):
        parts = [F.col(f"f{k}").bitwiseAND(F.lit(_signed(m)).cast("bigint")) for k, m in enumerate(mask) if m]
        keys.append(F.xxhash64(F.lit(t), *parts))
    return F.array(*keys)


# --- bit-sliced comparison ----------------------------------------------------------


def _planes(prints: np.ndarray) -> np.ndarray:
    """Bit planes of the rows, packed along the rows into words, with a spare word at the end."""
    rows, width = prints.shape
    words = (rows + 63) // 64 + 1
    bits = np.zeros((64 * width, words * 64), np.uint8)
    bits[:, :rows] = np.unpackbits(np.ascontiguousarray(prints).view(np.uint8), axis=1, bitorder="little").T
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def _packed(flags: np.ndarray, words: int) -> np.ndarray:
    out = np.zeros(words * 64, bool)
    out[:len(flags)] = flags
    return np.packbits(out, bitorder="little").view(np.uint64)


def _carry_save(a, b, c):
    u = a ^ b
    return u ^ c, (a & b) | (u & c)


def _over(counter: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose bit-sliced counter is above ``radius``."""
    above, equal = np.zeros_like(counter[0]), np.full_like(counter[0], FULL)
    for k in reversed(range(len(counter))):
        if radius >> k & 1:
            equal = equal & counter[k]
        else:
            above = above | (equal & counter[k])
            equal = equal & ~counter[k]
    return above


def within_radius(planes: np.ndarray, lag: int, lanes: np.ndarray, radius: int) -> np.ndarray:
    """Rows i, among those set in ``lanes``, whose distance to row i + lag is at most ``radius``.

    Eight planes at a time go through a tree of carry-save adders into a vertical counter; words all of whose lanes
    are above the radius, or not asked for, are abandoned after each eight.
    """
    skip, turn = divmod(lag, 64)
    at = np.flatnonzero(lanes)
    depth = int(planes.shape[0]).bit_length()
    counter = [np.zeros(len(at), np.uint64) for _ in range(depth)]
    alive = lanes[at]
    for top in range(0, planes.shape[0], 8):
        if not len(at):
            return np.empty(0, np.int64)
        own, low = planes[top:top + 8, at], planes[top:top + 8, at + skip]
        if turn:
            low = (low >> np.uint64(turn)) | (planes[top:top + 8, np.minimum(at + skip + 1, planes.shape[1] - 1)] << np.uint64(64 - turn))
        x = own ^ low
        ones, two_a = _carry_save(counter[0], x[0], x[1])
        ones, two_b = _carry_save(ones, x[2], x[3])
        twos, four_a = _carry_save(counter[1], two_a, two_b)
        ones, two_a = _carry_save(ones, x[4], x[5])
        ones, two_b = _carry_save(ones, x[6], x[7])
        twos, four_b = _carry_save(twos, two_a, two_b)
        fours, carry = _carry_save(counter[2], four_a, four_b)
        counter[:3] = [ones, twos, fours]
        for k in range(3, depth):
            counter[k], carry = counter[k] ^ carry, counter[k] & carry
        alive = alive & ~_over(counter, radius)
        keep = np.flatnonzero(alive)
        if 2 * len(keep) < len(at) or not len(keep):
            at, alive, counter = at[keep], alive[keep], [c[keep] for c in counter]
    bits = np.unpackbits(alive.view(np.uint8), bitorder="little").reshape(-1, 64)
    word, bit = np.nonzero(bits)
    return at[word] * 64 + bit


def _forest(prints: np.ndarray, starts: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between rows of one block that are within the radius, reduced to one link per row to a smaller one.

    ``starts`` are the first rows of the blocks, which come in order of falling size.
    """
    rows = len(prints)
    ends = np.append(starts[1:], rows)
    sizes, block_end = ends - starts, np.repeat(ends, ends - starts)
    planes, index = _planes(prints), np.arange(rows)
    labels, pending, held = index.copy(), [], 0
    for lag in range(1, int(sizes.max(initial=1))):
        last = int(ends[np.count_nonzero(sizes > lag) - 1])  # blocks larger than the lag come first
        lanes = _packed(index[:last] + lag < block_end[:last], (last + 63) // 64)
        hit = within_radius(planes, lag, lanes, radius)
        if len(hit):
            pending.append((hit, hit + lag))
            held += len(hit)
        if held > 2_000_000:
            labels = _joined(labels, pending)
            pending, held = [], 0
    labels = _joined(labels, pending)
    member = np.flatnonzero(labels != index)
    return member, labels[member]


def _joined(labels: np.ndarray, pending: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    if not pending:
        return labels
    old = np.flatnonzero(labels != np.arange(len(labels)))
    u = np.concatenate([old, *(a for a, _ in pending)])
    v = np.concatenate([labels[old], *(b for _, b in pending)])
    return smallest_labels(len(labels), u, v)


def _compare(width: int, radius: int):
    names = _names(width)

    def run(batches: Iterator[pa.RecordBatch]):
        def links(key, node, prints):
            border = np.flatnonzero(np.any(key[1:] != key[:-1], axis=1)) + 1
            starts = np.concatenate([[0], border]).astype(np.int64)
            sizes = np.diff(np.append(starts, len(key)))
            order = np.argsort(-sizes, kind="stable")
            order = order[sizes[order] > 1]
            if not len(order):
                return None
            rows = np.concatenate([np.arange(starts[k], starts[k] + sizes[k]) for k in order.tolist()])
            firsts = np.concatenate([[0], np.cumsum(sizes[order])[:-1]])
            a, b = _forest(prints[rows], firsts, radius)
            return pa.RecordBatch.from_arrays([pa.array(node[rows[a]]), pa.array(node[rows[b]])], names=["src", "dst"])

        held: list[tuple] = []
        count = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            column = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in batch.schema.names}
            held.append((np.stack([column["key"], column["a"], column["b"]], axis=1), column["node"],
                         np.stack([column[n] for n in names], axis=1).view(np.uint64)))
            count += batch.num_rows
            if count >= LANES:
                key, node, prints = (np.concatenate(x) for x in zip(*held))
                whole = len(key) - 1
                while whole and (key[whole - 1] == key[-1]).all():
                    whole -= 1
                if whole:
                    if (out := links(key[:whole], node[:whole], prints[:whole])) is not None:
                        yield out
                    held, count = [(key[whole:], node[whole:], prints[whole:])], len(key) - whole
                else:
                    held = [(key, node, prints)]
        if held:
            if (out := links(*(np.concatenate(x) for x in zip(*held)))) is not None:
                yield out

    return run


def _tiled(keyed: DataFrame, tile_rows: int, name: str) -> DataFrame:
    """``keyed`` with tiles ``a`` and ``b``: every row of a block of several tiles once for each pair its own tile is in."""
    large = stored(keyed.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > tile_rows)
                   .select("key", F.ceil(F.col("n") / tile_rows).cast("int").alias("tiles")), name)
    if large.count() <= HOT_KEYS_TO_BROADCAST:
        large = F.broadcast(large)
    tiles = F.coalesce("tiles", F.lit(1))
    own = F.pmod(F.xxhash64(F.lit("tile"), "node"), tiles).cast("int")
    return (keyed.join(large, "key", "left").withColumn("own", own)
            .withColumn("other", F.explode(F.sequence(F.lit(0), tiles - 1)))
            .select(*keyed.columns, F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b")))


def near_links(nodes: DataFrame, masks: list[list[int]], radius: int, tile_rows: int = TILE_ROWS) -> DataFrame:
    """``(src, dst)``: links that connect the ``nodes`` ``(node, f0, ...)`` as all pairs within ``radius`` that share a block do.

    Blocks above ``tile_rows`` are cut into tiles by a hash of the node, and every pair of tiles is one unit of work.
    """
    width = len(masks[0])
    keyed = nodes.select("node", *_names(width), F.explode(_block_keys(masks)).alias("key"))
    rows = _tiled(keyed, tile_rows, "large-blocks").select("key", "a", "b", "node", *_names(width))
    dealt = rows.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b")
    return dealt.mapInArrow(_compare(width, radius), "src long, dst long")


def near_groups(prints: DataFrame, masks: list[list[int]], radius: int) -> DataFrame:
    """``prints`` with ``component_id``, the smallest ``doc_id`` that links of at most ``radius`` bits reach.

    Equal fingerprints are one node, so a group of copies costs one comparison.  A missing id takes part, and names a
    component only if there is no other; repeated rows come back as often.
    """
    names = _names(len(masks[0]))
    prints = stored(prints, "fingerprints")
    nodes = prints.groupBy(*names).agg(F.min("doc_id").alias("low"), F.count("*").alias("held"))
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()), "fingerprint-nodes")
    return _in_components(prints, nodes, names, connected_components(near_links(nodes, masks, radius)))


def _in_components(prints: DataFrame, nodes: DataFrame, keys: list[str], joined: DataFrame) -> DataFrame:
    """``doc_id``, ``keys`` and ``component_id`` of ``prints``, whose distinct ``keys`` are ``nodes``, linked as ``joined`` says."""
    whole = nodes.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    whole = stored(whole.select("node", "low", "held", "component", *keys), "fingerprint-components")
    lowest = whole.groupBy("component").agg(F.min("low").alias("component_id"), F.count("*").alias("nodes"))
    named = spread_join(whole, lowest, ["component"], "nodes", whole.count()).select(*keys, "component_id", "held")
    return spread_join(prints, stored(named, "fingerprint-names"), keys, "held", prints.count()).select("doc_id", *keys, "component_id")


# --- exact similarity ---------------------------------------------------------------


def alike(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """The first row that links of at least this Jaccard similarity reach, for each of the sets of distinct hashes.

    Rows that are already joined aren't compared again, so a group of near copies costs little more than one pass.
    """
    labels, sizes = np.arange(len(sets)), np.array([len(x) for x in sets], np.int64)
    values, token = np.unique(np.concatenate(sets), return_inverse=True)
    row, ends = np.repeat(labels, sizes), np.cumsum(sizes)
    marked = np.zeros(len(values), bool)
    for i in range(len(sets) - 1):
        if (labels[i + 1:] == labels[i]).all():
            continue
        own, later = token[ends[i] - sizes[i]:ends[i]], slice(ends[i], None)
        marked[own] = True
        common = np.bincount(row[later][marked[token[later]]], minlength=len(sets))[i + 1:]
        marked[own] = False
        hit = np.flatnonzero(common * (1 + similarity) >= similarity * (sizes[i] + sizes[i + 1:]) - 1e-9) + i + 1
        if len(hit):
            met = np.unique(labels[np.append(hit, i)])
            labels[np.isin(labels, met)] = met[0]
    return labels


def _compare_sets(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]):
        def links(node, sets):
            labels = alike(sets, similarity)
            at = np.flatnonzero(labels != np.arange(len(labels)))
            node = np.array(node, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(node[labels[at]])], names=["src", "dst"])

        last, node, sets = None, [], []
        for batch in batches:
            for key, a, b, n, own in zip(*(batch.column(c).to_pylist() for c in ("key", "a", "b", "node", "shingles"))):
                if (key, a, b) != last:
                    if len(node) > 1:
                        yield links(node, sets)
                    last, node, sets = (key, a, b), [], []
                node.append(n)
                sets.append(np.frombuffer(own, np.uint64))
        if len(node) > 1:
            yield links(node, sets)

    return run


def similar_groups(docs: DataFrame, masks: list[list[int]], radius: int, words: int, similarity: float, set_rows: int = SET_ROWS) -> DataFrame:
    """``(doc_id, s0, s1, component_id)``: groups that links of at least ``similarity`` of the shingle sets make.

    Fingerprints only say where to look: within the groups that links of at most ``radius`` bits make, all pairs of
    sets are compared exactly, and only pairs with the similarity are links.  Texts with equal sets are one node.
    Groups above ``set_rows`` sets are cut into tiles, and every pair of tiles is one unit of work.  The sets are of
    64-bit hashes and are made again, from the texts, for one row of each node that has a candidate partner.
    """
    names, keys = _names(len(masks[0])), ["s0", "s1"]
    prints = stored(fingerprints(docs, words, len(masks[0]), digests=True), "fingerprints")
    nodes = prints.groupBy(*keys).agg(F.min("doc_id").alias("low"), F.count("*").alias("held"), F.min(F.struct(*names)).alias("print"))
    nodes = nodes.select(*keys, "low", "held", *[F.col("print")[n].alias(n) for n in names])
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()), "fingerprint-nodes")
    near = connected_components(near_links(nodes, masks, radius)).withColumnRenamed("component", "key")
    near = stored(nodes.join(near, "node").select(*keys, "low", "node", "key"), "candidate-groups")
    low = near.select("low").distinct()
    texts = docs.join(low, docs["doc_id"].eqNullSafe(low["low"]), "left_semi")
    sets = shingle_sets(texts, words).join(near.drop("low"), keys).select("key", "node", "shingles")
    sets = stored(sets, "candidate-sets")
    dealt = _tiled(sets, set_rows, "large-groups").repartition("key", "a", "b").sortWithinPartitions("key", "a", "b")
    linked = dealt.select("key", "a", "b", "node", "shingles").mapInArrow(_compare_sets(similarity), "src long, dst long")
    return _in_components(prints, nodes, keys, connected_components(linked))


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 3, parts: int = 6) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` per row, complete for ``radius`` of 64 bits.

    A text without words (missing, empty, blank) has fingerprint zero, which is linked like any other.  An empty
    table stays empty; further columns are not read.
    """
    out = near_groups(fingerprints(docs, words, 1), complete_masks(radius, parts), radius)
    return out.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


#: Wide fingerprints for similarity 0.8 on five words: 256 bits, of which such texts differ in about 15 %.
WIDE = {"words": 5, "width": 4, "radius": 56, "tables": 64, "bits": 16}
SIMILARITY = 0.8


def one_of_each_group(docs: DataFrame, words: int = WIDE["words"], width: int = WIDE["width"], radius: int = WIDE["radius"],
                      tables: int = WIDE["tables"], bits: int = WIDE["bits"], similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` without the near copies: of texts that links of at least ``similarity`` join, the row with the smallest id stays.

    Wide fingerprints find the candidates, and an exact comparison of the sets of shingles decides.  At a resemblance
    of 0.8 on five-word shingles fingerprints agree in about 85 % of their bits, so 64 blocks of 16 of 256 bits should
    bring 99 % of such pairs together; they differ in 39 bits on average, with a standard deviation of 6, so a radius
    of 56 should keep 99.8 % of them.  The search isn't complete: what it misses stays.
    ``bits`` should grow by one per doubling of a corpus beyond 10^8 texts, with ``tables`` in proportion to 1.18 per bit.

    Rows without words are near copies of each other.  Rows that share the kept id all stay; rows without an id stay
    if no other row is in their group.  An empty table stays empty; further columns are kept.
    """
    groups = similar_groups(docs, sampled_masks(tables, bits, width), radius, words, similarity)
    gone = groups.filter(F.col("component_id").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["_gone"]), "left_anti")
