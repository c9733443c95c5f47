"""Toxicity: a weighted lexicon, matched by Aho-Corasick in folded text and normalised by length.

Texts are folded first: case, look-alike letters of other scripts, and digits or signs that stand for
letters.  The lexicon holds whole words and word beginnings with weights, learned from labelled
documents; matches inside exception phrases don't count.  A logistic curve over matched weight and
length gives the score.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ionweave.llm.common import bucket, stored

# Look-alikes of Latin letters, and signs read as letters.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h",
    "ո": "n", "ս": "u", "ⅼ": "l", "ɡ": "g", "α": "a", "ο": "o", "ρ": "p", "ν": "v", "ι": "i", "κ": "k", "τ": "t", "υ": "u",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
EXCEPTIONS = ("trash can", "trash bin", "trash folder", "clown fish", "rodeo clown", "class clown")
STEM_CHARS = range(3, 8)
#: Bounds of the model: labelled documents it is fitted on, and lexicon entries.
SAMPLE_DOCS, MAX_ENTRIES = 20_000, 20_000


@lru_cache(maxsize=1)
def _table() -> dict[int, str]:
    table = {ord(k): v for k, v in {**HOMOGLYPHS, **SUBSTITUTES}.items()}
    table.update({c: " " for c in range(128) if chr(c) not in SUBSTITUTES and not chr(c).isalpha()})
    table.update({c: chr(c - 0xFEE0) for c in range(0xFF41, 0xFF5B)})
    return table


def fold(text: str | None) -> str:
    """Folded words between single spaces, with a space at either end."""
    return f" {' '.join((text or '').lower().translate(_table()).split())} "


@dataclass(frozen=True)
class Model:
    """Entries start with a space, whole words also end with one; ``curve`` is bias, weight part, length part."""

    weights: dict[str, float]
    curve: tuple[float, float, float]
    exceptions: tuple[str, ...] = EXCEPTIONS


class Matcher:
    def __init__(self, weights: dict[str, float], exceptions: tuple[str, ...]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for entry, weight in weights.items():
            self.automaton.add_word(entry, (len(entry), weight))
        for phrase in exceptions:
            self.automaton.add_word(f" {phrase} ", (len(phrase) + 2, None))
        self.automaton.make_automaton()
        self.empty = not len(self.automaton)

    def weight(self, folded: str) -> float:
        """Sum over words of their heaviest entry, without words inside exception phrases."""
        if self.empty:
            return 0.0
        best: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for end, (size, weight) in self.automaton.iter(folded):
            start = end - size + 1
            if weight is None:
                spared.append((start, end))
            elif weight > best.get(start, 0.0):
                best[start] = weight
        if spared:
            best = {s: w for s, w in best.items() if not _inside(s, spared)}
        return sum(best.values())


def _inside(start: int, spans: list[tuple[int, int]]) -> bool:
    """Whether a word start lies in one of the spans, which are sorted by their ends and don't nest."""
    from bisect import bisect_right

    k = bisect_right(spans, start, key=lambda s: s[1])
    return k < len(spans) and spans[k][0] <= start


def features(weight: float, folded: str) -> tuple[float, float]:
    """Matched weight and length, both on log scales: the curve's length part normalises the weight."""
    return math.log1p(weight), math.log2(2 + folded.count(" "))


def _sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def labelled_sample(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE_DOCS) -> DataFrame:
    """``(part, toxic, text)`` of about ``limit`` labelled rows that are not held out, drawn by a hash of the id.

    Of several labels of one id the larger counts.  The labels drawn are few by construction, and counted before they are
    broadcast; were they more, a plain join is used.
    """
    known = labels.filter("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("part", bucket(F.col("doc_id"))).filter("part <> 0")
    share = min(1.0, limit / max(1, known.count()))
    drawn = known.filter(F.pmod(F.xxhash64(F.lit("toxicity"), "doc_id"), F.lit(1_000_000)) < F.lit(share * 1_000_000))
    if drawn.limit(2 * limit + 1).count() <= 2 * limit:
        drawn = F.broadcast(drawn)
    return docs.select("doc_id", "text").join(drawn, "doc_id").select("part", "toxic", "text")


def entry_counts(sample: DataFrame) -> DataFrame:
    """``(entry, toxic, clean, toxic_4, clean_4)``: documents with each word or word beginning, in all parts and in part 4.

    Documents are counted once per distinct text; the empty entry counts the documents.
    """
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            seen = {(toxic, last): Counter() for toxic in (0, 1) for last in (False, True)}
            for toxic, part, text in zip(*(batch.column(n).to_pylist() for n in ("toxic", "part", "text"))):
                words = set(fold(text).split())
                entries = {f" {w} " for w in words}
                entries.update(f" {w[:n]}" for w in words for n in STEM_CHARS if len(w) >= n)
                entries.add("")
                seen[toxic, part == 4].update(entries)
            keys = list(set().union(*seen.values()))
            columns = [[seen[toxic, True][k] + (0 if last else seen[toxic, False][k]) for k in keys] for last in (False, True) for toxic in (1, 0)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array(c, pa.int64()) for c in columns)],
                                             names=["entry", "toxic", "clean", "toxic_4", "clean_4"])

    texts = (sample.groupBy(F.xxhash64("text").alias("h"), "toxic").agg(F.min(F.struct("part", "text")).alias("d"))
             .select(F.col("toxic").cast("int").alias("toxic"), "d.part", "d.text"))
    return (texts.mapInArrow(run, "entry string, toxic long, clean long, toxic_4 long, clean_4 long").groupBy("entry")
            .agg(*(F.sum(n).alias(n) for n in ("toxic", "clean", "toxic_4", "clean_4"))))


def learn_lexicon(counts: DataFrame, min_share: float = 0.004, min_lift: float = 2.5, min_z: float = 3.1, max_entries: int = MAX_ENTRIES) -> dict[str, float]:
    """Log-odds of the entries ``(entry, toxic, clean)`` that are much more frequent in toxic documents.

    An entry needs ``min_share`` of the toxic documents, log-odds of ``min_lift``, and these ``min_z`` standard
    deviations above zero, so that a small sample doesn't fill the lexicon with chance.  Of a beginning and a longer one in nearly the same documents the longer stays; of the others, one that a shorter
    beginning with the same odds includes is left out.
    """
    size = counts.filter("entry = ''").select("toxic", "clean").first()
    if size is None or not size["toxic"] or not size["clean"]:
        return {}
    lift = F.log((F.col("toxic") + 0.5) / (size["toxic"] + 1.0)) - F.log((F.col("clean") + 0.5) / (size["clean"] + 1.0))
    deviation = F.sqrt(1.0 / (F.col("toxic") + 0.5) + 1.0 / (F.col("clean") + 0.5))
    rows = (counts.filter((F.col("entry") != "") & (F.col("toxic") >= min_share * size["toxic"])).withColumn("lift", lift)
            .filter((F.col("lift") >= min_lift) & (F.col("lift") >= min_z * deviation)).orderBy(F.desc(F.col("lift") * F.col("toxic")), "entry").limit(max_entries).collect())
    found = {r["entry"]: (r["lift"], r["toxic"]) for r in rows}

    def stems(entry: str) -> list[str]:
        return [s for n in range(4, len(entry)) if (s := entry[:n]) in found]

    covered = {s for e in found for s in stems(e) if found[e][1] >= 0.95 * found[s][1]}
    kept = found.keys() - covered
    return {e: round(found[e][0], 4) for e in sorted(kept)
            if not any(s in kept and found[s][0] >= found[e][0] - 0.3 for s in stems(e))}


def fit(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE_DOCS) -> Model:
    """Lexicon from the whole sample; the curve from part 4 of it, matched with a lexicon of parts 1 to 3.

    Labels are all that is learned from besides texts.
    """
    sample = labelled_sample(docs, labels, limit)
    counts = stored(entry_counts(sample), "lexicon-counts")
    weights = learn_lexicon(counts.select("entry", (F.col("toxic") - F.col("toxic_4")).alias("toxic"), (F.col("clean") - F.col("clean_4")).alias("clean")))

    def run(batches: Iterator[pa.RecordBatch]):
        matcher = Matcher(weights, EXCEPTIONS)
        for batch in batches:
            folded = [fold(t) for t in batch.column("text").to_pylist()]
            x = [features(matcher.weight(f), f) for f in folded]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array([a for a, _ in x], pa.float64()), pa.array([b for _, b in x], pa.float64())], names=["toxic", "a", "b"])

    rows = sample.filter("part = 4").select(F.col("toxic").cast("int").alias("toxic"), "text").mapInArrow(run, "toxic int, a double, b double").collect()
    return Model(learn_lexicon(counts), _logistic([(r["a"], r["b"]) for r in rows], [r["toxic"] for r in rows]))


def _logistic(points: list[tuple[float, float]], toxic: list[int], ridge: float = 1e-2) -> tuple[float, float, float]:
    """Newton steps for three coefficients; without rows of both kinds nothing is called toxic."""
    if len(set(toxic)) < 2:
        return (-5.0, 0.0, 0.0)
    rows = sorted(zip(points, toxic))  # rows arrive in any order; sums of floats should not
    x, y = np.array([(1.0, *p) for p, _ in rows]), np.array([t for _, t in rows], dtype=float)
    b = np.zeros(3)
    for _ in range(50):
        p = _sigmoid(x @ b)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(3), x.T @ (y - p) - ridge * b)
        b += step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(round(float(v), 6) for v in b)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` and ``score``, 0 to 1, from the text alone.

    A missing or empty text scores by the curve without matches.  Rows are independent: repeated rows and ids come
    back as often, an empty table stays empty.  Further columns are kept; ``score`` is replaced.  The model is
    bounded by its number of entries and travels with the tasks; nothing is shuffled.
    """
    docs = docs.drop("score")

    def run(batches: Iterator[pa.RecordBatch]):
        matcher, (bias, by_weight, by_length) = Matcher(model.weights, model.exceptions), model.curve
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                folded = fold(text)
                a, b = features(matcher.weight(folded), folded)
                out.append(float(_sigmoid(bias + by_weight * a + by_length * b)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], names=[*batch.schema.names, "score"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("score", DoubleType())]))


def predictions(docs: DataFrame, model: Model) -> DataFrame:
    held = (bucket(F.col("doc_id")) == 0).alias("held_out")
    return score(docs.select("doc_id", "text"), model).select("doc_id", held, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
