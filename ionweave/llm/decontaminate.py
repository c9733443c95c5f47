"""Benchmark decontamination: rare seeds, then local alignment.

An alignment that reaches the threshold matches a known least number of an item's words, in a stretch of bounded length.
So the rarest words of an item, as many as leave too few others, are its seeds (counted over all documents): every
copy holds a number of them close together.  Where it does, and enough of the item's other words are there too, the
passage goes to Smith-Waterman alignment by words, which scores copies with edits, insertions and gaps.  No copy above the
threshold is missed, however its words are changed.
"""

from __future__ import annotations

import math
from collections import Counter
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionweave.llm.license_scan import fold

#: Items of fewer words count only as whole.
SHORT = 3
#: Items whose words travel with the tasks at once; more items are taken in blocks of this size.
ITEMS_AT_ONCE = 5_000
MATCH, MISS, GAP = 2, -1, -1
#: Rows whose texts a task unpacks at once.
ROWS_AT_ONCE = 500
#: Words of documents that a task looks at together.
WORDS_AT_ONCE = 300_000


def _words(text: str | None) -> list[bytes]:
    return fold(text).split()


class Items:
    """Test items as word numbers, with what an alignment of at least ``threshold`` needs.

    With m matched, x exchanged and g left or added words an alignment scores 2 m - x - g.  If that is at least
    s = 2 n threshold for n words, m is at least s / 2, and it spans at most m + x + g <= 3 m - s <= 3 n - s words.
    """

    def __init__(self, items: dict[int, list[bytes]], threshold: float):
        self.ids = sorted(k for k, w in items.items() if w)
        self.words = {w: i for i, w in enumerate(sorted({w for k in self.ids for w in items[k]}))}
        self.codes = {k: np.array([self.words[w] for w in items[k]], np.int32) for k in self.ids}
        size = np.array([len(self.codes[k]) for k in self.ids], np.int64)
        self.score = np.where(size < SHORT, MATCH * size, np.ceil(MATCH * size * threshold - 1e-9)).astype(np.int64)
        self.matched = np.maximum(1, -(-self.score // MATCH))
        self.span = 3 * size - self.score
        self.size = size
        self.sorted_words, self.times = [], []
        for k in self.ids:
            words, times = np.unique(self.codes[k], return_counts=True)
            self.sorted_words.append(words)
            self.times.append(times)

    def seeds(self, documents: dict[int, int]) -> None:
        """Choose the rarest words: n - m + k of n, so that m matches hold k of them; k is up to half of m."""
        self.needed = np.maximum(1, self.matched // 2)
        word, item, times = [], [], []
        for at, k in enumerate(self.ids):
            codes = self.codes[k]
            order = sorted(range(len(codes)), key=lambda i: (documents.get(int(codes[i]), 0), int(codes[i])))
            chosen = {int(codes[i]) for i in order[:len(codes) - int(self.matched[at]) + int(self.needed[at])]}
            word += sorted(chosen)
            item += [at] * len(chosen)
            times += [int((codes == w).sum()) for w in sorted(chosen)]
        order = np.lexsort((item, word))
        self.seed_item, self.seed_times = np.array(item, np.int64)[order], np.array(times, np.int64)[order]
        self.first = np.searchsorted(np.array(word, np.int64)[order], np.arange(len(self.words) + 1))


    def most_matches(self, item: int, codes: np.ndarray) -> int:
        """The most words of an item that one stretch of its span can match, each as often as the item has it.

        A place counts for all beginnings of a stretch from which it is reached before its word is used up.
        """
        at = np.flatnonzero(np.isin(codes, self.sorted_words[item]))
        if len(at) < self.matched[item]:
            return 0
        slot = np.searchsorted(self.sorted_words[item], codes[at])
        order = np.argsort(slot, kind="stable")
        slot, place = slot[order], at[order]
        begin, end = _beginnings(place, slot, self.times[item][slot], self.span[item])
        change = np.bincount(np.maximum(begin, 0), minlength=len(codes) + 1) - np.bincount(end, minlength=len(codes) + 1)
        return int(np.cumsum(change).max())


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(at, ROWS_AT_ONCE)


def word_documents(docs: DataFrame, items: Items) -> dict[int, int]:
    """In how many rows each word of the items occurs; one sum per word comes back."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in _parts(batches):
            seen: Counter = Counter()
            for text in batch.column("text").to_pylist():
                seen.update(items.words.keys() & set(_words(text)))
            yield pa.RecordBatch.from_arrays([pa.array([items.words[w] for w in seen], pa.int64()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    rows = docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {r["word"]: r["n"] for r in rows}


def _stretches(at: np.ndarray, codes: np.ndarray, items: Items) -> Iterator[tuple[int, int, int]]:
    """``(item, from, to)``: stretches of the rising places ``at`` of items' words that can hold the whole of an alignment."""
    times = items.first[codes + 1] - items.first[codes]
    place = np.repeat(at, times)
    entry = np.repeat(items.first[codes], times) + np.arange(len(place)) - np.repeat(np.cumsum(times) - times, times)
    order = np.argsort(entry, kind="stable")
    place, entry = place[order], entry[order]
    item = items.seed_item[entry]
    begin, end = _beginnings(place, entry, items.seed_times[entry], items.span[item])
    wide = int(place.max(initial=0)) + int(items.span.max(initial=0)) + 2
    key = np.concatenate([item * wide + begin, item * wide + end]) + int(items.span.max(initial=0))
    order = np.argsort(key, kind="stable")
    key, count = key[order], np.cumsum(np.repeat([1, -1], len(item))[order])
    enough = np.flatnonzero((np.append(key[1:], -1) != key) & (count >= items.needed[np.minimum(key // wide, len(items.needed) - 1)]))
    item, begin = key[enough] // wide, key[enough] % wide - int(items.span.max(initial=0))
    end = key[enough + 1] % wide - int(items.span.max(initial=0)) - 1 + items.span[item]
    begin, end, item, k = begin.tolist(), end.tolist(), item.tolist(), 0
    while k < len(item):
        to, j = end[k], k + 1
        while j < len(item) and item[j] == item[k] and begin[j] <= to and end[j] - begin[k] <= 8 * items.span[item[k]]:
            to, j = max(to, end[j]), j + 1
        yield item[k], begin[k], to
        k = j


def _beginnings(place: np.ndarray, group: np.ndarray, times: np.ndarray, span) -> tuple[np.ndarray, np.ndarray]:
    """From where to where a stretch can begin so that a place counts: within its span, and its word not used up before.

    Places of a group, one word of one item, follow each other; ``times`` is how often the item has the word.
    """
    before = np.arange(len(place)) - times
    used = (before >= 0) & (group[before] == group)
    return np.maximum(np.where(used, place[before], -1 << 40), place - span) + 1, place + 1


def passages(items: Items):
    """What makes ``(doc_id, item_id, start, passage)`` of documents: words that can hold a copy of an item, with enough of its words close together."""

    def cut(ids: list, starts: list[int], texts: list[list[bytes]]) -> list[tuple]:
        gap = 2 * int(items.span.max(initial=0)) + 1  # so that no stretch reaches from one text into the next
        begin = np.cumsum([0] + [len(w) for w in texts])
        codes = np.fromiter((items.words.get(x, -1) for w in texts for x in w), np.int64, begin[-1])
        at = np.flatnonzero(codes >= 0)
        moved = gap * np.arange(len(texts))
        out = []
        for item, lo, hi in _stretches(at + moved[np.searchsorted(begin, at, side="right") - 1], codes[at], items):
            d = int(np.searchsorted(begin[:-1] + moved, lo + items.span.max(), side="right")) - 1
            lo, hi = max(lo - int(moved[d]), int(begin[d])), min(hi - int(moved[d]), int(begin[d + 1]))
            if items.most_matches(item, codes[lo:hi]) >= items.matched[item]:
                a = lo - int(begin[d])
                out.append((ids[d], items.ids[item], starts[d] + a, b" ".join(texts[d][a:hi - int(begin[d])]).decode("utf-8", "surrogatepass")))
        return out

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in _parts(batches):
            out, ids, texts, starts, held = [], [], [], [], 0
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                words = _words(text)
                for start in range(0, max(1, len(words)), WORDS_AT_ONCE):  # parts of a very long text overlap by what a copy can cover
                    ids.append(doc_id)
                    starts.append(start)
                    texts.append(words[start:start + WORDS_AT_ONCE + 2 * int(items.span.max(initial=0))])
                    held += len(texts[-1])
                    if held >= WORDS_AT_ONCE:
                        out += cut(ids, starts, texts)
                        ids, texts, starts, held = [], [], [], 0
            if ids:
                out += cut(ids, starts, texts)
            cols = list(zip(*out)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], batch.column("doc_id").type), *[pa.array(c, t) for c, t in zip(cols[1:], (pa.int64(), pa.int64(), pa.string()))]],
                                             names=["doc_id", "item_id", "start", "passage"])

    return run


def smith_waterman(pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Best local alignment score of each pair of word-number arrays; all pairs advance together, by anti-diagonals."""
    n, m = max(len(a) for a, _ in pairs), max(len(b) for _, b in pairs)
    left, right = np.full((len(pairs), n), -1, np.int32), np.full((len(pairs), m), -2, np.int32)
    for k, (a, b) in enumerate(pairs):
        left[k, :len(a)], right[k, :len(b)] = a, b
    best = np.zeros(len(pairs), np.int32)
    before, last = np.zeros((len(pairs), n + 1), np.int32), np.zeros((len(pairs), n + 1), np.int32)
    for d in range(n + m - 1):  # cell (i, d - i); column i + 1 of the arrays holds row i
        lo, hi = max(0, d - m + 1), min(n - 1, d)
        same = left[:, lo:hi + 1] == right[:, d - hi:d - lo + 1][:, ::-1]
        now = np.zeros_like(last)
        cell = np.maximum(before[:, lo:hi + 1] + np.where(same, MATCH, MISS), 0)
        gap = np.maximum(last[:, lo:hi + 1], last[:, lo + 1:hi + 2]) + GAP
        now[:, lo + 1:hi + 2] = np.maximum(cell, gap)
        best = np.maximum(best, now.max(axis=1))
        before, last = last, now
    return best


def aligned(wanted: Items, cells: int = 2_000_000):
    """What gives passages their ``score``: the alignment score over that of a full match, 0 to 1."""

    def run(batches: Iterator[pa.RecordBatch]):
        ids = wanted.codes
        for batch in batches:
            items = batch.column("item_id").to_pylist()
            rows = [np.fromiter((wanted.words.get(w, -3) for w in p.encode("utf-8", "surrogatepass").split()), np.int32) for p in batch.column("passage").to_pylist()]
            score = np.zeros(len(items))
            order, at = sorted(range(len(items)), key=lambda k: (len(ids[items[k]]), len(rows[k]))), 0
            while at < len(order):
                longest = order[at]
                take = max(1, min(256, cells // max(1, len(ids[items[longest]]) * len(rows[longest]))))
                part = order[at:at + take]
                best = smith_waterman([(ids[items[k]], rows[k]) for k in part])
                for k, s in zip(part, best.tolist()):
                    score[k] = s / (MATCH * len(ids[items[k]]))
                at += take
            kept = [n for n in batch.schema.names if n != "passage"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(score, pa.float64())], names=[*kept, "score"])

    return run


def aligned_passages(docs: DataFrame, wanted: Items) -> DataFrame:
    """``(doc_id, item_id, start, score)``: passages are cut and aligned by one Python worker of a task, not by two at a time."""
    cut, align = passages(wanted), aligned(wanted)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lambda batches: align(cut(batches)), f"doc_id {kind}, item_id long, start long, score double")


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, least_words: int = 1) -> DataFrame:
    """``(doc_id, item_id, score, start)`` of every row and test item whose best alignment reaches ``threshold``.

    ``score`` is 1 for a whole copy; ``start`` is the first word of the best passage, the first of equal ones.  Words are
    runs of letters and digits with A-Z lowered, so changed punctuation doesn't matter.  The search is complete for the
    alignment over whole texts.

    * Missing and empty texts match nothing; so do missing items, items without words and those of fewer than
      ``least_words``.  Items of one or two words are found as a whole only.
    * Repeated rows give one result per id; items of one id are taken as the longest of them.  Empty tables give an
      empty table.  Further columns are not read.  Very long texts are searched as a whole, their passages one by one.
    * Items are taken in blocks of at most about 5,000, so what travels with the tasks is bounded; every block is
      compared with all documents.  Passages hold a few item lengths, never a whole text, and are aligned where they
      are cut; a passage in a third of all documents is spread as they are.
    """
    items = (benchmark.filter("item_id is not null and text is not null").groupBy("item_id")
             .agg(F.max_by("text", F.struct(F.length("text"), F.col("text"))).alias("text")))
    blocks = max(1, math.ceil(items.count() / ITEMS_AT_ONCE))
    out = None
    for k in range(blocks):
        block = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).collect()
        words = {r["item_id"]: _words(r["text"]) for r in block}
        wanted = Items({k: w for k, w in words.items() if len(w) >= least_words}, threshold)
        wanted.seeds(word_documents(docs, wanted))
        short = [k for k, n in zip(wanted.ids, wanted.size) if n < SHORT]
        found = aligned_passages(docs, wanted).filter((F.col("score") >= threshold - 1e-9) & (~F.col("item_id").isin(short) | (F.col("score") == 1)))
        out = found if out is None else out.unionByName(found)
    best = out.groupBy("doc_id", "item_id").agg(F.max(F.struct("score", (-F.col("start")).alias("s"))).alias("b"))
    return best.select("doc_id", "item_id", F.col("b.score").alias("score"), (-F.col("b.s")).alias("start"))


def without_contaminated(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` without the rows whose id is in ``found``; rows without an id are matched as one id."""
    ids = found.select(F.col("doc_id").alias("_hit")).distinct()
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["_hit"]), "left_anti")
