"""Short codes for vectors: codebooks per part, by exact integer matrix products.

Components become integers.  A dot product of integers is exact in float64 while every partial sum stays at or
below 2^53, so numbers are broken into limbs narrow enough for that, the limbs go through float64 matrix products, and
the products are put together again in int64.  Distances are then whole numbers: the nearest entry, its ties and the
sums of every round are the same on any number of tasks.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from typing import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionweave.llm.common import spread_join, stored

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6


def limb_bits(width: int) -> int:
    """The widest limbs whose products, ``width`` of them summed, stay at or below 2^53."""
    return (53 - max(1, width).bit_length()) // 2


def limbs(values: np.ndarray, bits: int) -> list[np.ndarray]:
    """``values`` (int64) as float64 limbs of ``bits`` bits, lowest first; the last one carries the sign."""
    largest = max(int(values.max(initial=0)), -int(values.min(initial=0)))
    count = max(1, -(-largest.bit_length() // bits))
    low = [(values >> (bits * i)) & ((1 << bits) - 1) for i in range(count - 1)]
    return [part.astype(np.float64) for part in [*low, values >> (bits * (count - 1))]]


def exact_dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b.T`` of int64 matrices, exact as long as the result fits in int64."""
    bits = limb_bits(a.shape[1])
    out = np.zeros((len(a), len(b)), np.int64)
    right = limbs(b, bits)
    for i, x in enumerate(limbs(a, bits)):
        for j, y in enumerate(right):
            out += (x @ y.T).astype(np.int64) << (bits * (i + j))
    return out


def nearest(rows: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First nearest entry of every row, and the squared distance to it."""
    distance = (rows * rows).sum(1)[:, None] - 2 * exact_dot(rows, entries) + (entries * entries).sum(1)[None, :]
    first = distance.argmin(1)
    return first, distance[np.arange(len(rows)), first]


def largest_integer(width: int) -> int:
    """Integers up to this size keep all squared distances of vectors of ``width`` components within int64."""
    return int((2**62 / max(1, width)) ** 0.5) // 2 - 1


def integer_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """``(vec_id, label, ints)`` of the rows whose vector is there and has finite components only, as a table.

    A component becomes ``floor(scale * component)``.  One too large for exact distances is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            column = batch.column("embedding")
            flat = pc.cast(column.flatten(), pa.float64()).to_numpy(zero_copy_only=False)
            size = pc.list_value_length(column).to_numpy(zero_copy_only=False)
            there = ~np.isnan(size.astype(np.float64))
            size = size[there].astype(np.int64)
            row = np.repeat(np.arange(len(size)), size)
            good = np.bincount(row[~np.isfinite(flat)], minlength=len(size)) == 0
            with np.errstate(over="ignore"):
                ints = np.floor(scale * flat[good[row]])
            size = size[good]
            if len(ints) and np.abs(ints).max() > largest_integer(int(size.max())):
                raise ValueError(f"a component is beyond {largest_integer(int(size.max()))} / {scale}: distances would not fit in 64 bits")
            there[there] = good
            kept = batch.filter(pa.array(there))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(ints.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([kept.column("vec_id"), kept.column("label"), lists], names=["vec_id", "label", "ints"])

    kinds = {name: vectors.schema[name].dataType.simpleString() for name in ("vec_id", "label")}
    out = vectors.select("vec_id", "label", "embedding").mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, ints array<int>")
    return stored(out, "integer-vectors")


def _matrices(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        yield batch, batch.column("ints").flatten().to_numpy().astype(np.int64).reshape(len(batch), width)


@dataclass(frozen=True)
class Codebooks:
    """Integer entries by part, entry and position in the part; an array of three dimensions."""

    entries: np.ndarray

    @property
    def width(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def part(self, rows: np.ndarray, k: int) -> np.ndarray:
        size = self.entries.shape[2]
        return rows[:, k * size:(k + 1) * size]


def _part_sums(rows: DataFrame, books: Codebooks) -> dict[int, int]:
    """Component sums of the parts nearest to each entry, followed by their number; one flat list of slots.

    A task returns one row per slot it has something for, so what is summed doesn't grow with the rows of a task.
    """
    parts, entries, size = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]):
        total = np.zeros((parts, entries, size + 1), np.int64)
        for _, matrix in _matrices(batches, books.width):
            for k in range(parts):
                part = books.part(matrix, k)
                code, _ = nearest(part, books.entries[k])
                np.add.at(total[k, :, :size], code, part)
                total[k, :, size] += np.bincount(code, minlength=entries)
        flat = total.ravel()
        used = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(flat[used], pa.int64())], names=["slot", "total"])

    sums = rows.select("ints").mapInArrow(run, "slot long, total long").groupBy("slot").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    return {r["slot"]: int(r["total"]) for r in sums.collect()}


def train(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks of :func:`integer_vectors`, started at the ``entries`` smallest ids (equal ids: smaller vectors first).

    Every round assigns all parts of all rows; an entry becomes the floor of its parts' mean, and stays if it has none.
    A missing id comes after all others.  Vectors of unequal length, or of a length that ``parts`` doesn't divide, are an
    error.  Without rows there are no entries.
    """
    sizes = rows.agg(F.min(F.size("ints")).alias("a"), F.max(F.size("ints")).alias("b")).first()
    width = sizes["a"] or 0
    if sizes["a"] != sizes["b"] or width % parts:
        raise ValueError(f"vectors have {sizes['a']} to {sizes['b']} components; one length that {parts} divides is needed")
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "ints").limit(entries).collect()
    start = np.array([r["ints"] for r in first], np.int64).reshape(len(first), parts, width // parts)
    books = Codebooks(start.transpose(1, 0, 2).copy())
    for _ in range(rounds if first else 0):
        size, sums = width // parts, _part_sums(rows, books)
        new = books.entries.copy()
        for k in range(parts):
            for e in range(len(first)):
                at = (k * len(first) + e) * (size + 1)
                if n := sums.get(at + size, 0):
                    new[k, e] = [sums.get(at + j, 0) // n for j in range(size)]
        books = Codebooks(new)
    return books


def encode(rows: DataFrame, books: Codebooks) -> DataFrame:
    """``(vec_id, label, code, error)``: two hex digits per part, and the squared distances to the entries named."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch, matrix in _matrices(batches, books.width):
            found = [nearest(books.part(matrix, k), books.entries[k]) for k in range(len(books.entries))]
            digits = np.stack([code for code, _ in found], 1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array([r.tobytes().hex() for r in digits], pa.string()),
                 pa.array(sum(d for _, d in found), pa.int64())], names=["vec_id", "label", "code", "error"])

    kinds = {name: rows.schema[name].dataType.simpleString() for name in ("vec_id", "label")}
    return rows.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def decode(codes: DataFrame, books: Codebooks, scale: int = SCALE) -> DataFrame:
    """``codes`` with a column ``embedding``: the vector of the named entries, at the middle of their integer steps."""
    size = books.entries.shape[2]
    table = [[[(v + 0.5) / scale for v in e] for e in part] for part in books.entries.tolist()]

    def run(batches: Iterator[pa.RecordBatch]):
        values = np.array(table).reshape(len(table), -1, size)
        for batch in batches:
            digits = np.frombuffer(bytes.fromhex("".join(batch.column("code").to_pylist())), np.uint8).reshape(len(batch), len(table))
            rows = np.concatenate([values[k][digits[:, k]] for k in range(len(table))], 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(rows), pa.list_(pa.float64()))], names=[*batch.schema.names, "embedding"])

    kept = codes.drop("embedding")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields]
    return kept.mapInArrow(run, ", ".join([*fields, "embedding array<double>"]))


def compressed(vectors: DataFrame) -> DataFrame:
    """``(vec_id, code, error, label_error, codebooks_sha256)``, one row per vector that is kept.

    * Rows whose vector is missing or has missing or non-finite components are left out, from the codebooks too.
    * Repeated rows and ids stay, and count as often; ties go to the entry with the lower index.
    * Missing labels are one label.  An empty table gives an empty table; further columns are not read.
    * Vectors are read in Arrow batches, so memory doesn't depend on the table; a longer vector is more work, nothing else.

    A label with a third of all rows is summed in parts and its sum brought to where its rows are.
    """
    rows = integer_vectors(vectors)
    books = train(rows)
    if not books.entries.size and rows.isEmpty():
        return rows.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"),
                           F.lit("").alias("codebooks_sha256"))
    blank = F.lit(0).cast(rows.schema["label"].dataType)
    coded = stored(encode(rows, books).select("vec_id", "code", "error", F.col("label").isNull().alias("none"), F.coalesce("label", blank).alias("key")), "vector-codes")
    labels = coded.groupBy("none", "key").agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error"), F.count("*").alias("rows"))
    out = spread_join(coded, stored(labels, "label-errors"), ["none", "key"], "rows", coded.count())
    return out.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
