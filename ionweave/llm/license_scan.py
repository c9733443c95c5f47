"""License scan: exact set-similarity join of text blocks with license templates.

Tokens of the templates are ordered by how many documents of the whole corpus have them, rarest
first.  A block can only contain a template to the threshold if it has one of the template's first
tokens in that order (prefix filter), enough tokens at all (length filter), and enough of them left
behind every match (positional filter); what passes is counted exactly.
"""

from __future__ import annotations

import math
from collections import Counter
from typing import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed phrases of the base scan, with their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Notices as their licenses word them: label, words, and the words among them that name the license and have to be there.
TEMPLATES = [
    ("apache", "licensed under the apache license version 2 0", "apache"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at apache org licenses license 2 0", "apache"),
    ("mit", "released under the mit license", "mit"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ""),
    ("gpl", "this work is licensed under the gnu general public license version 3", "gnu general"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gnu general"),
    ("lgpl", "this work is licensed under the gnu lesser general public license version 3", "gnu lesser"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", "gnu lesser"),
    ("agpl", "this work is licensed under the gnu affero general public license version 3", "gnu affero"),
    ("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", "gnu affero"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", "creative commons noncommercial"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", "creative commons sharealike"),
    ("cc-by-nd", "this work is licensed under a creative commons attribution noderivatives 4 0 international license", "creative commons noderivatives"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ""),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla"),
]
THRESHOLD = 0.8
BLOCK_WORDS, BLOCK_STEP = 64, 32

_WORD_BYTES = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
#: A-Z to a-z, word bytes and line feeds as they are, all else to spaces.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _WORD_BYTES or b == 0x0A else 0x20 for b in range(256))


def fold(text: str | None) -> bytes:
    """The text as UTF-8 with A-Z lowered and everything between words but line feeds made a space."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD)


def token_order(docs: DataFrame, templates=TEMPLATES) -> dict[bytes, int]:
    """Rank of every template token by the number of documents that have it, rarest first, ties by token.

    One partial count per batch is shuffled; what reaches the driver is one row per template token.
    """
    vocabulary = frozenset(w for _, t, _ in templates for w in t.encode().split())

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            seen = Counter()
            for text in batch.column("text").to_pylist():
                seen.update(vocabulary.intersection(fold(text).split()))
            yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], names=["token", "n"])

    rows = docs.select("text").mapInArrow(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    count = {r["token"].encode(): r["n"] for r in rows}
    return {w: k for k, w in enumerate(sorted(vocabulary, key=lambda w: (count.get(w, 0), w)))}


class TemplateIndex:
    """Prefix index of the templates in a global token order."""

    def __init__(self, order: dict[bytes, int], templates, threshold: float):
        self.order, self.labels = order, [label for label, _, _ in templates]
        self.sets = [frozenset(t.encode().split()) for _, t, _ in templates]
        self.marks = [frozenset(m.encode().split()) for _, _, m in templates]
        self.need = [max(1, math.ceil(threshold * len(s) - 1e-9)) for s in self.sets]
        self.prefix: dict[bytes, list[tuple[int, int]]] = {}
        for k, s in enumerate(self.sets):
            for i, w in enumerate(sorted(s, key=order.__getitem__)[: len(s) - self.need[k] + 1]):
                self.prefix.setdefault(w, []).append((k, i))

    def matches(self, words: list[bytes]) -> list[tuple[int, float]]:
        """``(template, containment)`` of the templates that the block contains to the threshold, their marks included.

        Of two licenses, one whose words in the block are all among the other's, and fewer, is left out: the text
        has a word more, such as "lesser", that the other license's notice has too.
        """
        block = sorted(self.order.keys() & set(words), key=self.order.__getitem__)
        met: Counter = Counter()
        for j, w in enumerate(block):
            for k, i in self.prefix.get(w, ()):
                left = min(len(self.sets[k]) - i - 1, len(block) - j - 1)  # positional filter, with the length filter in it
                met[k] = met[k] + 1 if met[k] >= 0 and met[k] + 1 + left >= self.need[k] else -len(block) - 1
        found = [(k, self.sets[k].intersection(block)) for k, n in met.items() if n > 0]
        found = [(k, own) for k, own in found if len(own) >= self.need[k] and self.marks[k] <= own]
        return [(k, len(own) / len(self.sets[k])) for k, own in found
                if not any(own < other and self.labels[k] != self.labels[o] for o, other in found)]


def longest_template(templates=TEMPLATES) -> int:
    return max((len(t.split()) for _, t, _ in templates), default=0)


def _places(joined: bytes) -> list[tuple[int, str]]:
    """Start word and label of every base phrase in words that are joined and surrounded by single spaces."""
    out = []
    for phrase, label in PHRASES.items():
        key, at = b" " + phrase.encode() + b" ", -1
        at = joined.find(key)
        while at >= 0:
            out.append((at, label))
            at = joined.find(key, at + 1)
    out.sort()
    word, last, placed = 0, 0, []
    for at, label in out:
        word += joined.count(b" ", last, at)
        last = at
        placed.append((word, label))
    return placed


def _blocks(words: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """A line as one block; a longer one in overlapping blocks, so that every run of 32 words is inside one."""
    for start in range(0, max(1, len(words) - BLOCK_STEP), BLOCK_STEP) if len(words) > BLOCK_WORDS else (0,):
        yield start, words[start:start + BLOCK_WORDS]


def _runs(words: list[bytes], longest: int) -> Iterator[tuple[int, list[bytes]]]:
    """Overlapping blocks of the whole text across line feeds, so that every run of ``longest`` words is inside one."""
    size = BLOCK_STEP + max(BLOCK_STEP, longest)
    for start in range(0, max(1, len(words) - size + BLOCK_STEP), BLOCK_STEP):
        yield start, words[start:start + size]


def scan(docs: DataFrame, order: dict[bytes, int], templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, n_words, places, blocks)`` per row: base phrases, and blocks that contain a template.

    ``places`` has ``(start, label)`` for every place where a base phrase's words stand consecutively, ``blocks``
    has ``(start, label, containment)`` for every block and template with a containment of at least ``threshold`` that
    has the template's naming words; of two licenses in a block, the one with only a part of the other's words goes.
    Words count from 0 over the whole text; a block is a line, or overlapping 64 words of a longer line, and also
    overlapping 64 words (more if a template has over 32) of a text of several lines, so that a notice may be wrapped.

    A missing or empty text has no words.  Every row comes back once, repeated rows too; an empty table stays
    empty; further columns are not read.  Templates and their token order are fixed and small, so they travel
    with the tasks, and nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        index = TemplateIndex(order, templates, threshold)
        first = index.prefix.keys()
        longest = longest_template(templates)
        pair = pa.list_(pa.struct([("start", pa.int64()), ("label", pa.string())]))
        triple = pa.list_(pa.struct([("start", pa.int64()), ("label", pa.string()), ("containment", pa.float64())]))
        for batch in batches:
            n_words, places, blocks = [], [], []
            for text in batch.column("text").to_pylist():
                folded = fold(text)
                words = folded.split()
                n_words.append(len(words))
                hits = []
                if not first.isdisjoint(words):
                    base = 0
                    for line in folded.split(b"\n"):
                        own = line.split()
                        if not first.isdisjoint(own):
                            for start, block in _blocks(own):
                                hits += [{"start": base + start, "label": index.labels[k], "containment": c} for k, c in index.matches(block)]
                        base += len(own)
                    if len(words) > len(own):  # the last line isn't all there is
                        for start, block in _runs(words, longest):
                            if not first.isdisjoint(block):
                                hits += [{"start": start, "label": index.labels[k], "containment": c} for k, c in index.matches(block)]
                blocks.append(hits)
                found = []
                if b"license" in folded or b"cc" in folded:
                    found = [{"start": at, "label": label} for at, label in _places(b" " + b" ".join(words) + b" ")]
                places.append(found)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(places, pair), pa.array(blocks, triple)],
                                             names=["doc_id", "n_words", "places", "blocks"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, (
        f"doc_id {kind}, n_words long, places array<struct<start: long, label: string>>, "
        "blocks array<struct<start: long, label: string, containment: double>>"))


def _joined(labels: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")


def digest(found: DataFrame) -> DataFrame:
    starts = F.col("places.start")
    return found.select(
        "doc_id", "n_words", F.size("places").cast("bigint").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), _joined(F.col("places.label")).alias("base_labels"),
        _joined(F.concat(F.col("places.label"), F.col("blocks.label"))).alias("labels"),
        F.coalesce(F.array_max(F.col("blocks.containment")), F.lit(0.0)).alias("score"))
