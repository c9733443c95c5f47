"""Packing tokenised documents into sequences of one length, by rounds of best fit over shrinking groups.

Documents longer than a sequence are cut; full pieces are sequences of their own.  The other pieces are dealt by a hash
into groups of bounded size, and each group is packed by best fit, longest first.  Sequences that are nearly full are done.
The others are items of the next round, in as many fewer groups as there are fewer items: the tree ends in one group, or
where a round hardly joins anything any more.
"""

from __future__ import annotations

import re
import struct
import zlib
from functools import lru_cache
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionweave.llm.common import stored

SEQUENCE = 2048
#: Items in a group; a task holds one group at a time.
GROUP_ITEMS = 32_768
#: A sequence with this much room or less is done.
SLACK = 4
#: A round that joins a smaller share of its items than this is the last.
LEAST_JOINED = 0.01
CACHE_WORDS, CACHED_BYTES = 300_000, 64


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _alphabet() -> dict[int, str]:
    """The printable stand-in of every byte: printable Latin-1 as it is, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _WordIds(dict):
    """Little-endian ids of words between white space, as bytes.

    The tokenizer drops white space and no token spans it, so a text's ids are those of its words in order.  Words of
    printable ASCII and Latin-1 letters, without a special token's mark, are cut as the tokenizer's pattern does and go to
    its merges directly.  Short words are kept; a full table becomes the older one, from which words in use come back.
    """

    plain = re.compile("(?:(?!<\\|)[!-~À-ÖØ-öø-ÿ])+")
    #: The tokenizer's pattern where only these characters occur (fixed value).
    cut = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
    alphabet = _alphabet()

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.merges = self.tokenizer.model.tokenize
        self.older: dict[bytes, bytes] = {}

    def _ids(self, word: str) -> list[int]:
        if len(word) > CACHED_BYTES or not self.plain.fullmatch(word):
            return self.tokenizer.encode(word, add_special_tokens=False).ids
        pieces = self.cut.findall(word.lower())
        if not word.isascii():
            pieces = [piece.encode().decode("latin-1").translate(self.alphabet) for piece in pieces]
        return [t.id for piece in pieces for t in self.merges(piece)]

    def __missing__(self, word: bytes) -> bytes:
        ids = self.older.pop(word, None)
        if ids is None:
            found = self._ids(word.decode())
            ids = struct.pack(f"<{len(found)}I", *found)
        if len(word) <= CACHED_BYTES:
            if len(self) >= CACHE_WORDS:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids


@lru_cache(maxsize=1)
def word_ids(path: str) -> _WordIds:
    return _WordIds(path)


def text_ids(text: str, path: str) -> bytes:
    """Ids of ``text`` as little-endian unsigned 32-bit numbers; ``bytes.split`` cuts at the six ASCII blanks only."""
    return b"".join(map(word_ids(path).__getitem__, text.encode().split()))


def pieces(docs: DataFrame, path: str, length: int = SEQUENCE, end_id: int = 0) -> DataFrame:
    """``(item, doc_id, piece, start, length, ids_crc32)`` as a table; ``item`` numbers all pieces of all rows."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            row, number, start, size, crc = [], [], [], [], []
            for at, text in enumerate(batch.column("text").to_pylist()):
                ids = text_ids(text or "", path) + end
                for k, first in enumerate(range(0, len(ids), 4 * length)):
                    cut = ids[first:first + 4 * length]
                    row.append(at)
                    number.append(k)
                    start.append(first // 4)
                    size.append(len(cut) // 4)
                    crc.append(zlib.crc32(cut))
            taken = batch.column("doc_id").take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([taken, *[pa.array(c, pa.int64()) for c in (number, start, size, crc)]],
                                             names=["doc_id", "piece", "start", "length", "ids_crc32"])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece long, start long, length long, ids_crc32 long"
    cut = docs.select("doc_id", "text").mapInArrow(run, schema)
    return stored(cut.select(F.monotonically_increasing_id().alias("item"), "*"), "pieces")


def best_fit(sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """``(bin, offset)`` of every size, taken in the given order: the fullest bin with enough room, or else a new one.

    Bins stand in stacks by their room, and a bit per stack tells which ones hold any.
    """
    stacks: list[list[int]] = [[] for _ in range(length + 1)]
    filled, bins = 0, 0
    at, offset = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    for i, size in enumerate(sizes.tolist()):
        fitting = filled >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = stacks[room].pop()
            if not stacks[room]:
                filled ^= 1 << room
        else:
            b, room, bins = bins, length, bins + 1
        at[i], offset[i] = b, length - room
        if room > size:
            stacks[room - size].append(b)
            filled |= 1 << (room - size)
    return at, offset


def _pack_group(table: pa.Table, length: int) -> pa.Table:
    item, size = (table.column(n).to_numpy() for n in ("item", "size"))
    order = np.lexsort((item, -size))
    item, size = item[order], size[order]
    at, offset = best_fit(size, length)
    fill = np.bincount(at, size).astype(np.int64)
    head = item[np.flatnonzero(offset == 0)]  # bins are opened in order, and their first item names them
    return pa.table({"item": item, "bin": head[at], "offset": offset, "fill": fill[at]})


def pack(items: DataFrame, length: int = SEQUENCE, group_items: int = GROUP_ITEMS, slack: int = SLACK) -> DataFrame:
    """``(item, bin, offset)`` for rows ``(item, size)`` with distinct items and sizes from 1 to ``length``.

    ``bin`` is the item at offset 0.  Groups are hash samples, so that they hold all sizes alike wherever rows came from,
    and their content doesn't depend on partitions.  What is open after a round is less than one bin that is half empty per
    group, so stopping early costs at most one sequence per ``group_items``.
    """
    rounds, rest = [], items.select("item", F.col("size").cast("long").alias("size"))
    left = rest.count()
    while True:
        groups = max(1, -(-left // group_items))
        dealt = rest.withColumn("group", F.pmod(F.xxhash64(F.lit(len(rounds)), F.col("item")), F.lit(groups)))
        packed = dealt.groupBy("group").applyInArrow(lambda t: _pack_group(t, length), "item long, bin long, offset long, fill long")
        packed = stored(packed, f"packed-{len(rounds)}")
        rounds.append(packed.select("item", "bin", "offset"))
        rest = packed.filter((F.col("offset") == 0) & (F.col("fill") < length - slack)).select("item", F.col("fill").alias("size"))
        still = rest.count()
        if groups == 1 or still > left * (1 - LEAST_JOINED):
            break
        left = still
    top = rounds.pop()
    while rounds:
        above = top.select(F.col("item").alias("bin"), F.col("bin").alias("upper"), F.col("offset").alias("shift"))
        top = rounds.pop().join(above, "bin", "left").select(
            "item", F.coalesce("upper", "bin").alias("bin"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"))
    return top


def packed_documents(docs: DataFrame, path: str, length: int = SEQUENCE) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)``, one row per piece.

    * A missing text is the empty text: one piece that holds the end id alone.  Every row has at least one piece.
    * Repeated rows and ids are packed as often as they come; a missing id stays missing.
    * A very long text is cut into full pieces and one rest; only its own ids are held while it is cut.
    * Pieces of equal length are taken in the order of their numbers, so ties don't depend on partitions.
    * An empty table gives an empty table; further columns are not read.
    """
    cut = pieces(docs, path, length)
    placed = pack(cut.filter(F.col("length") < length).select("item", F.col("length").alias("size")), length)
    full = cut.filter(F.col("length") == length).withColumn("sequence_id", F.col("item")).withColumn("offset", F.lit(0).cast("long"))
    rest = cut.filter(F.col("length") < length).join(placed.withColumnRenamed("bin", "sequence_id"), "item")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return full.select(columns).unionByName(rest.select(columns))
