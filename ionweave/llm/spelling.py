"""Spelling variants: words one edit apart, found by walking a trie of all words against itself.

The trie is a table of edges ``(node, char, child)``, where a node is named by its prefix.  A state of the walk is ``(prefix,
position, node, edits)``: ``prefix`` stands for every word that begins with it, so words share their states as long as they share
their letters, and no node has more states than there are prefixes one edit away from its own.  Level by level the states are
joined with the edges below ``prefix`` and those below ``node``.  States without an edit are the nodes themselves; they give a
state with one edit for two different children (replaced) and for a child against its parent (inserted, which is deleted
when read the other way).  A node with one word below is that word, and two of these end at once.
"""

from __future__ import annotations

import zlib
from collections import Counter
from typing import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionweave.llm.common import stored
from ionweave.session import sorted_slices

LEAST_LETTERS, LEAST_COUNT, DELETE_EVERY, FORM_RATIO = 5, 3, 97, 2
#: One byte per code point: letters A to Z lower-cased, the other letters of runs as they are, anything else a space.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))
#: Code points of a text cut in one go, and words counted in a task before they are handed on.
SLICE_CHARS, HELD_WORDS = 1 << 20, 300_000


def _runs(text: str) -> Counter:
    """Counts of the lower-cased runs of letters, in Latin-1; long texts are taken in slices that end between runs."""
    letters, counts, at = text.encode("latin-1", "replace").translate(LETTERS), Counter(), 0
    while at < len(letters):
        end = letters.find(b" ", at + SLICE_CHARS)
        end = len(letters) if end < 0 else end
        counts.update(letters[at:end].split())
        at = end
    return counts


def _with_deletion(word: bytes, seed: int, every: int) -> bytes:
    """``word``, or, for one hash in ``every``, ``word`` without the code point that the hash names."""
    h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), seed)
    if h % every:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1:]


def word_counts(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, every: int = DELETE_EVERY) -> DataFrame:
    """``(word, n)`` as a table: the words of all texts, counted in the tasks before they are shuffled."""

    def rows(counts: Counter):
        return pa.RecordBatch.from_arrays([pa.array([word.decode("latin-1") for word in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]):
        held: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                seed = zlib.crc32(f"{doc_id}:".encode())
                for word, n in _runs(text or "").items():
                    word = _with_deletion(word, seed, every)
                    if len(word) >= least_letters:
                        held[word] += n
                if len(held) >= HELD_WORDS:
                    yield rows(held)
                    held.clear()
        yield rows(held)

    ids = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), "text")
    counted = ids.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return stored(counted.filter(F.col("n") >= least_count), "words")


def _char(text: Column, at: Column) -> Column:
    """The code point at ``at`` (from 0); empty behind the end."""
    return F.substring(text, at + 1, F.lit(1))


def _shared(a: str, b: str) -> int:
    """Code points that both words begin with."""
    return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def own_depths(words: DataFrame) -> DataFrame:
    """``(word, own)``: the length from which on a word's prefix is no other word's.

    Words are sorted in slices; only the first and the last word of a slice are handed to its neighbours.
    """
    slices = sorted_slices(words.select("word"), "word")

    def bounds(batches: Iterator[pa.RecordBatch]):
        first = last = None
        for batch in batches:
            if batch.num_rows:
                first, last = first or batch.column(0)[0].as_py(), batch.column(0)[-1].as_py()
        if first:
            yield pa.RecordBatch.from_pydict({"slice": pa.array([TaskContext.get().partitionId()], pa.int64()), "first": [first], "last": [last]})

    ends = sorted(slices.mapInArrow(bounds, "slice long, first string, last string").collect(), key=lambda r: r["slice"])
    before = {b["slice"]: a["last"] for a, b in zip(ends, ends[1:])}
    after = {a["slice"]: b["first"] for a, b in zip(ends, ends[1:])}

    def run(batches: Iterator[pa.RecordBatch]):
        here = TaskContext.get().partitionId()
        last, held = before.get(here, ""), None
        for batch in batches:
            names = batch.column(0).to_pylist()
            if held is not None:
                names.insert(0, held)
            held = names.pop() if names else held
            if names:
                shared = [_shared(x, y) for x, y in zip([last, *names], [*names, held])]
                last = names[-1]
                yield pa.RecordBatch.from_pydict({"word": names, "own": pa.array([1 + max(p) for p in zip(shared, shared[1:])], pa.int32())})
        if held is not None:
            own = 1 + max(_shared(last, held), _shared(held, after.get(here, "")))
            yield pa.RecordBatch.from_pydict({"word": [held], "own": pa.array([own], pa.int32())})

    return slices.mapInArrow(run, "word string, own int")


def trie(words: DataFrame) -> DataFrame:
    """Nodes with several words below, ``(node, depth, kids)``, as a table with a part per depth.

    ``kids`` are the edges ``(ch, child, one)``, at most one per letter: ``child`` is the longer prefix or, where ``one`` says
    so, the only word below; the end of a word is the empty ``ch``.  Edges are collected in the tasks before they meet.
    """
    depth = F.explode(F.sequence(F.lit(0), F.col("own") - 1))
    at = own_depths(words).select("word", "own", depth.alias("depth"))
    node, ch = F.substring(F.col("word"), F.lit(1), F.col("depth")), _char(F.col("word"), F.col("depth"))
    one = (F.col("depth") + 1 >= F.col("own")) | (ch == "")
    kid = F.struct(ch.alias("ch"), F.when(one, F.col("word")).otherwise(F.concat(node, ch)).alias("child"), one.alias("one"))
    return stored(at.groupBy(node.alias("node"), "depth").agg(F.collect_set(kid).alias("kids")), "trie", "depth")


def _kids(states: DataFrame, side: str, nodes: DataFrame, small: bool, depth: Column) -> DataFrame:
    """``states`` with ``kids_<side>``; a word that is alone has the one edge that it spells itself.

    A word must not meet a node of its name, so it gets a key that no node has.
    """
    alone = F.col(f"{side}_one")
    keyed = states.withColumn("_key", F.when(alone, F.concat(F.lit("!"), side)).otherwise(F.col(side)))
    table = nodes.select(F.col("node").alias("_key"), F.col("kids").alias("_kids"))
    found = keyed.join(F.broadcast(table) if small else table.hint("merge"), "_key", "left")
    own = F.array(F.struct(_char(F.col(side), depth).alias("ch"), F.col(side).alias("child"), F.lit(True).alias("one")))
    return found.withColumn(f"kids_{side}", F.when(alone, own).otherwise(F.col("_kids"))).drop("_key", "_kids")


def _tail(text: str, depth: Column) -> Column:
    return F.substring(F.col(text), depth + 1, F.length(text))


#: Nodes of a depth that may be broadcast; each has at most as many edges as there are letters.
NODES_TO_BROADCAST = 10_000


def near_pairs(words: DataFrame) -> DataFrame:
    """``(a, b)`` as a table: all pairs of different words of a table ``(word, …)`` one edit apart, each in one order.

    ``words`` has distinct words.  There are as many levels as the longest prefix that two words share, and a few more
    where letters repeat.  A pair comes back once, although a doubled letter can be inserted in two places.
    """
    nodes = trie(words)
    counts = {r["depth"]: r["n"] for r in nodes.groupBy("depth").agg(F.count("*").alias("n")).collect()}
    small = lambda *depths: sum(counts.get(d, 0) for d in depths) <= NODES_TO_BROADCAST
    depth, found, open_ = 0, [], None
    while depth in counts or open_ is not None and not open_.isEmpty():
        here = nodes.filter(F.col("depth") == depth).select("node", "kids")
        kid = here.select("node", "kids", F.explode("kids").alias("p")).filter("p.ch <> ''")
        two = kid.select("p", F.explode("kids").alias("q")).filter("q.ch > p.ch").select(
            "p.ch", F.col("p.child").alias("a"), F.col("p.one").alias("a_one"), F.col("q.child").alias("b"), F.col("q.one").alias("b_one"), F.lit(0).alias("gap"))
        down = kid.select("p.ch", F.col("node").alias("a"), F.lit(False).alias("a_one"), F.col("p.child").alias("b"), F.col("p.one").alias("b_one"), F.lit(1).alias("gap"))
        states = two.unionByName(down)
        if open_ is not None:
            # prefixes of two lengths can't be equal, so both depths of ``a`` are looked up at once
            both = nodes.filter(F.col("depth").isin(depth, depth - 1)).select("node", "kids")
            met = _kids(open_, "a", both, small(depth, depth - 1), F.lit(depth) - F.col("gap"))
            met = _kids(met, "b", here, small(depth), F.lit(depth))
            met = met.select("gap", "kids_b", F.explode("kids_a").alias("p"))
            met = met.select("gap", "p", F.explode(F.filter("kids_b", lambda q: q["ch"] == F.col("p.ch"))).alias("q"))
            states = states.unionByName(met.select(
                "p.ch", F.col("p.child").alias("a"), F.col("p.one").alias("a_one"), F.col("q.child").alias("b"), F.col("q.one").alias("b_one"), "gap"))
        # Here b stands below depth + 1 code points and a below ``gap`` fewer; an empty ch means that both have ended.
        both = F.col("a_one") & F.col("b_one")
        same = _tail("a", F.lit(depth + 1) - F.col("gap")) == _tail("b", F.lit(depth + 1))
        kept = states.filter((F.col("ch") == "") | ~both | same).withColumn("done", (F.col("ch") == "") | both)
        kept = stored(kept.drop("ch"), f"states-{depth}")
        found.append(kept.filter("done").select("a", "b"))
        open_ = kept.filter("not done").drop("done")
        depth += 1
    if not found:
        return words.select(F.col("word").alias("a"), F.col("word").alias("b")).limit(0)
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    return stored(pairs.distinct(), "near-words")


def forms(words: DataFrame, pairs: DataFrame, ratio: int = FORM_RATIO) -> DataFrame:
    """``(word, n, n_near, form, form_n)`` as a table for words ``(word, n)`` and pairs ``(a, b)`` in one order."""
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.join(words.select(F.col("word").alias("b"), F.col("n").alias("near_n")), "b")
    best = near.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("b").alias("form"))).alias("best"))
    strong = -F.col("best.less") >= ratio * F.col("n")
    return stored(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(strong, F.col("best.form")).alias("form"),
        F.when(strong, -F.col("best.less")).alias("form_n")), "word-forms")


def with_roots(table: DataFrame) -> DataFrame:
    """``table`` of :func:`forms` with ``root``: forms are walked from the words without one downwards.

    A form is at least twice as frequent as its word, so the walk ends, after at most as many rounds as the
    largest count has bits; the words of one form are at most its near words.
    """
    done, level = [table.filter("form is null").withColumn("root", F.col("word"))], 0
    while True:
        above = done[-1].select(F.col("word").alias("form"), "root")
        step = stored(table.filter("form is not null").join(above, "form"), f"word-roots-{level}")
        if step.isEmpty():
            break
        done.append(step)
        level += 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def variants(docs: DataFrame) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)``, one row per word of at least 5 letters that occurs at least 3 times.

    * Missing and empty texts have no words; a missing id counts as the empty text where a run's deletion is drawn.
    * Repeated rows and ids count as often as they come.  Forms of equal count: the first word in code-point order.
    * Very long texts are read in slices between runs; a very long run is one word.
    * An empty table gives an empty table; further columns are not read.
    """
    words = word_counts(docs)
    return with_roots(forms(words, near_pairs(words))).select("word", "form", "root", "n", "n_near", "form_n")
