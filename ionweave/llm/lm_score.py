"""Scoring by a bigram model in Elias-Fano tries, sharded by word.

The model is p(w | c) = (count(c w) + mu p(w)) / (count(c) + mu), with p(w) smoothed as in the base
score.  In a document's sum of logarithms the numerators belong to the words and the denominators to
the same words as contexts, so everything about a word is in one shard of the words: its counts, its
contexts, and the places where documents use it.  Documents send their word-context pairs to the shards
once; a shard counts the training part, builds its trie, looks all pairs up, and sends one partial sum
per document back.  Words that make up more than a thousandth of the corpus (at most a thousand of
them) are counted beforehand and dealt out by word and context.
"""

from __future__ import annotations

import math
import zlib
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from ionweave.llm.common import stored
from ionweave.llm.elias_fano import CONTEXT_BITS, Trie

TOKENS_PER_SHARD = 3_000_000
#: A task works on documents of about so many tokens at a time; a longer document is taken alone.
CHUNK_TOKENS = 1_000_000
HOT_SHARE = 1e-3
END, BEGIN = b"\n", b"\t"  # no words: they hold a blank
MU = 4.0
PARTS = "shard int, batch long, words binary, pairs binary, prev binary, posts binary, doc binary, times binary, ids array<{id}>, held binary, n_tokens binary"


class _Hashes(dict):
    """64-bit hashes of words, kept while there is room."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = xxhash.xxh64_intdigest(word)
        if len(self) < 500_000:
            self[word] = h
        return h


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def is_training(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 != 1


def _mix(h: np.ndarray) -> np.ndarray:
    z = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return z ^ (z >> np.uint64(29))


def _pack(a: np.ndarray) -> bytes:
    """The numbers in their smallest unsigned type, named by the first byte."""
    a = a.astype(np.min_scalar_type(int(a.max(initial=0))))
    return a.dtype.char.encode() + a.tobytes()


def _unpack(b: bytes) -> np.ndarray:
    return np.frombuffer(b, np.dtype(chr(b[0])), offset=1)


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[list, list[list[bytes]]]]:
    """Ids and tokens of the batch's documents, a chunk at a time."""
    ids, words, held = [], [], 0
    for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
        ids.append(doc_id.as_py())
        words.append(tokens(text.as_py()))
        held += len(words[-1]) + 1
        if held >= CHUNK_TOKENS:
            yield ids, words
            ids, words, held = [], [], 0
    if ids:
        yield ids, words


def word_counts(docs: DataFrame) -> DataFrame:
    """``(h, n)``: hash and count of every token of the training texts, ends included."""

    def run(batches: Iterator[pa.RecordBatch]):
        known = _Hashes()
        for ids, words in (chunk for batch in batches for chunk in _chunks(batch)):
            flat: list[int] = []
            for doc_id, own in zip(ids, words):
                if is_training(doc_id):
                    flat.extend(map(known.__getitem__, own))
                    flat.append(known[END])
            h, n = np.unique(np.array(flat, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

    return docs.select("doc_id", "text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def _emit(shards: int, hot: np.ndarray, id_type):
    """Turn batches of documents into one row per shard with the pairs it needs, and one with the documents."""

    def run(batches: Iterator[pa.RecordBatch]):
        known, number = _Hashes(), TaskContext.get().partitionId() << 32
        end, begin = known[END], known[BEGIN]
        for ids, chunk in (chunk for batch in batches for chunk in _chunks(batch)):
            lengths, flat = [], []
            for own in chunk:
                flat.append(begin)
                flat.extend(map(known.__getitem__, own))
                flat.append(end)
                lengths.append(len(own) + 1)
            size = np.array(lengths, np.int64)
            train = np.array([is_training(d) for d in ids], bool)
            everything = np.array(flat, np.uint64)
            del flat, chunk, own
            first = np.zeros(len(everything), bool)
            first[np.concatenate([[0], np.cumsum(size + 1)[:-1]]).astype(np.int64)[:len(ids)]] = True
            word, prev = everything[~first], everything[np.flatnonzero(~first) - 1]
            doc = np.repeat(np.arange(len(ids)) * 2 + train, size)
            context = _mix(prev) >> np.uint64(64 - CONTEXT_BITS)
            spread = np.where(np.isin(word, hot), _mix(word ^ prev), _mix(word))
            shard = (spread % np.uint64(shards)).astype(np.int64)
            order = np.lexsort((doc, context, word, shard))
            word, context, doc, shard = word[order], context[order], doc[order], shard[order]
            del everything, prev, spread, order, first
            new_word = np.append(True, (word[1:] != word[:-1]) | (shard[1:] != shard[:-1]))
            new_pair = new_word | np.append(True, context[1:] != context[:-1])
            new_post = new_pair | np.append(True, doc[1:] != doc[:-1])
            post, pair, words = np.flatnonzero(new_post), np.flatnonzero(new_pair), np.flatnonzero(new_word)
            times = np.diff(np.append(post, len(word)))
            pair_posts = np.diff(np.append(np.searchsorted(post, pair), len(post)))
            word_pairs = np.diff(np.append(np.searchsorted(pair, words), len(pair)))
            held = np.packbits(~train, bitorder="little").tobytes()
            rows = [(int(-1 - number % shards), number, None, None, None, None, None, None, ids, held, _pack(size))]
            present = np.unique(shard)
            for s, lo, hi in zip(present.tolist(), np.searchsorted(shard, present).tolist(), np.searchsorted(shard, present, side="right").tolist()):
                w, p, q = (slice(*np.searchsorted(x, (lo, hi))) for x in (words, pair, post))
                prev_bytes = np.ascontiguousarray(context[pair[p]].view(np.uint8).reshape(-1, 8)[:, :CONTEXT_BITS // 8]).tobytes()
                rows.append((s, number, word[words[w]].tobytes(), _pack(word_pairs[w]), prev_bytes, _pack(pair_posts[p]), _pack(doc[post[q]]), _pack(times[q]), None, None, None))
            number += 1
            kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 6, pa.list_(id_type), pa.binary(), pa.binary()]
            names = ["shard", "batch", "words", "pairs", "prev", "posts", "doc", "times", "ids", "held", "n_tokens"]
            for at in range(0, len(rows), 64):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[at:at + 64]), kinds)], names=names)

    return run


class _Part:
    """The pairs of one batch of documents in one shard."""

    def __init__(self, row: dict):
        self.batch = row["batch"]
        self.words = np.frombuffer(row["words"], np.uint64)
        self.word_pairs, self.pair_posts = _unpack(row["pairs"]).astype(np.int64), _unpack(row["posts"]).astype(np.int64)
        raw = np.frombuffer(row["prev"], np.uint8).reshape(-1, CONTEXT_BITS // 8)
        wide = np.zeros((len(raw), 8), np.uint8)
        wide[:, :raw.shape[1]] = raw
        self.context = wide.view(np.uint64).reshape(-1)
        self.doc, self.times = _unpack(row["doc"]), _unpack(row["times"])

    def trained(self) -> np.ndarray:
        """Training count of every pair."""
        count = np.where(self.doc & 1, self.times, 0).astype(np.int64)
        return np.add.reduceat(count, np.cumsum(self.pair_posts) - self.pair_posts)


def build_trie(parts: list[_Part], hot: np.ndarray, hot_counts: np.ndarray, p_scale: float, mu: float):
    """Trie of the training pairs of one shard, and the training count of each of its words."""
    counts = [p.trained() for p in parts]
    words = np.unique(np.concatenate([hot, *(np.repeat(p.words, p.word_pairs)[n > 0] for p, n in zip(parts, counts))]))
    keys = [np.empty(0, np.uint64)]  # hot words are known in every shard
    for p, n in zip(parts, counts):
        owner = np.searchsorted(words, p.words).astype(np.uint64) << np.uint64(CONTEXT_BITS)
        keys.append((np.repeat(owner, p.word_pairs) | p.context)[n > 0])
    key = np.concatenate(keys)
    del keys
    order = np.argsort(key)
    key, count = key[order], np.concatenate([np.empty(0, np.int64), *(n[n > 0] for n in counts)])[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))[:len(key)]
    pair_count = np.add.reduceat(count, first) if len(first) else count
    key = key[first]
    del order, count, counts, first
    pair_word = (key >> np.uint64(CONTEXT_BITS)).astype(np.int64)
    word_count = np.bincount(pair_word, pair_count, len(words)).astype(np.int64)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, words), len(hot) - 1)
        word_count = np.where(hot[at] == words, hot_counts[at], word_count)
    weight = mu * (word_count + 0.5) * p_scale
    trie = Trie(words, pair_word, key & np.uint64((1 << CONTEXT_BITS) - 1), np.log10(weight), np.log10(pair_count + weight[pair_word]))
    return trie, word_count


def _score(hot: np.ndarray, hot_counts: np.ndarray, p_scale: float, mu: float, id_type):
    """Score the parts of each shard with the shard's own trie; one row of partial sums per batch."""
    end = np.uint64(_Hashes()[END])
    names = ["batch", "doc", "base", "known", "score", "ids", "held", "n_tokens"]
    kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.list_(id_type), pa.binary(), pa.binary()]

    def one(part: _Part, trie: Trie, word_count: np.ndarray):
        node = trie.find_words(part.words)
        count = np.where(node >= 0, word_count[np.maximum(node, 0)] if len(word_count) else 0, 0)
        unseen = math.log10(mu * 0.5 * p_scale)
        back = np.where(node >= 0, trie.word_values[np.maximum(node, 0)], unseen) if len(word_count) else np.full(len(node), unseen)
        owner = np.repeat(np.arange(len(part.words)), part.word_pairs)
        at = trie.find_contexts(node[owner], part.context)
        value = np.where(at >= 0, trie.pair_values[np.maximum(at, 0)], back[owner]) if len(word_count) else back[owner]
        value = value - np.where(part.words == end, 0.0, np.log10(count + mu))[owner]
        base = np.log10((count + 0.5) * p_scale)[owner]
        of_pair = np.repeat(np.arange(len(owner)), part.pair_posts)
        doc, times = (part.doc >> 1).astype(np.int64), part.times.astype(np.float64)
        docs, slot = np.unique(doc, return_inverse=True)
        sums = [np.bincount(slot, times * x[of_pair], len(docs)) for x in (base, (count > 0)[owner].astype(np.float64), value)]
        return part.batch, _pack(docs), sums[0].tobytes(), _pack(sums[1].astype(np.int64)), sums[2].astype(np.float32).tobytes(), None, None, None

    def finish(rows: list[dict]):
        parts = [_Part(r) for r in rows]
        trie, word_count = build_trie(parts, hot, hot_counts, p_scale, mu)
        out = [one(p, trie, word_count) for p in parts]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]):
        held, shard = [], None
        for batch in batches:
            for row in batch.to_pylist():
                if row["words"] is None:
                    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((row["batch"], None, None, None, None, row["ids"], row["held"], row["n_tokens"]), kinds)], names=names)
                    continue
                if row["shard"] != shard and held:
                    yield finish(held)
                    held = []
                shard = row["shard"]
                held.append(row)
        if held:
            yield finish(held)

    return run


def _gather(begin_log: float, train_tokens: int, id_type):
    """Add up the partial sums of each batch of documents."""

    def flush(sums, head):
        base, known, score = sums
        n = _unpack(head["n_tokens"]).astype(np.int64)
        held = np.unpackbits(np.frombuffer(head["held"], np.uint8), bitorder="little")[:len(n)].astype(bool)
        return pa.RecordBatch.from_arrays(
            [pa.array(head["ids"], id_type), pa.array(held), pa.array(n), pa.array(known.astype(np.int64)), pa.array(np.full(len(n), train_tokens)),
             pa.array(base), pa.array(score - begin_log)],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    def run(batches: Iterator[pa.RecordBatch]):
        at, sums, head = None, None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["batch"] != at:
                    if head is not None:
                        yield flush(sums, head)
                    at, sums, head = row["batch"], None, None
                if row["ids"] is not None:  # sorted first
                    head = row
                    sums = np.zeros((3, len(row["ids"])))
                    continue
                doc = _unpack(row["doc"])
                sums[0, doc] += np.frombuffer(row["base"], np.float64)
                sums[1, doc] += _unpack(row["known"])
                sums[2, doc] += np.frombuffer(row["score"], np.float32)
        if head is not None:
            yield flush(sums, head)

    return run


def score_documents(docs: DataFrame, mu: float = MU, tokens_per_shard: int = TOKENS_PER_SHARD) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` for every row.

    The model is learned from all rows whose crc32 of the id is not 1 modulo 5, and scores all rows.  ``score`` is the
    base-10 logarithm of the text's probability, its terms quantised to 256 values per level and shard; counts and
    ``base_score`` are exact up to collisions of 64-bit word hashes (contexts of one word: 40 bits).

    * A missing or empty text has the end token only; a missing id counts as the empty text and is trained on.
    * Every row comes back once, and repeated rows count as often as they occur; an empty table stays empty.
      Without training rows all tokens are unknown.  Further columns are not read.
    * What a shard holds is bounded by ``tokens_per_shard`` on average; the number of shards grows with the corpus.
    """
    counts = stored(word_counts(docs), "word-counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n, v = total["n"], total["v"]
    hot_rows = sorted((r["h"] & 0xFFFFFFFFFFFFFFFF, r["n"]) for r in counts.filter(F.col("n") > F.lit(max(1.0, n * HOT_SHARE))).collect())
    hot, hot_counts = np.array([h for h, _ in hot_rows], np.uint64), np.array([c for _, c in hot_rows], np.int64)
    end = np.uint64(_Hashes()[END])
    begins = int(sum(r["n"] for r in counts.filter(F.col("h") == F.lit(int(end.astype(np.int64)))).collect()))
    p_scale, shards = 1.0 / (n + 0.5 * (v + 1)), max(1, math.ceil(1.25 * n / tokens_per_shard))
    arrow_id = pa.schema(docs.select("doc_id").limit(0).toArrow().schema).field(0).type
    sent = docs.select("doc_id", "text").mapInArrow(_emit(shards, hot, arrow_id), PARTS.format(id=docs.schema["doc_id"].dataType.simpleString()))
    dealt = sent.repartition("shard").sortWithinPartitions("shard")
    sums = dealt.mapInArrow(_score(hot, hot_counts, p_scale, mu, arrow_id), (
        "batch long, doc binary, base binary, known binary, score binary, "
        f"ids array<{docs.schema['doc_id'].dataType.simpleString()}>, held binary, n_tokens binary"))
    back = sums.repartition("batch").sortWithinPartitions("batch", F.col("ids").isNull())
    return back.mapInArrow(_gather(math.log10(begins + mu), n, arrow_id), (
        f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"))
