"""Token counts at every prefix of a text, for a byte-level BPE tokenizer.

The tokenizer never merges across the pieces its pattern cuts, so the count at the end of piece k is
the count at the end of piece k-1 plus the tokens of piece k.  Inside a piece the same recurrence
runs over its bytes: the encoding of a prefix ends with the one vocabulary entry that is a valid
neighbour of the last token before it, and its count is one more than there.  Truncation and budget
questions then need the stored counts and at most one piece.
"""

from __future__ import annotations

from bisect import bisect_right
from functools import lru_cache
from typing import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The public pattern of this tokenizer family (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE_PIECES = 1_000_000
CACHED_CHARS = 64


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _PieceCounts(dict):
    """Token counts of whole pieces, filled as they come; short pieces are kept until the table is full."""

    def __init__(self, tokenize, special):
        self.tokenize, self.special = tokenize, special

    def __missing__(self, piece: str) -> int:
        n = 1 if self.special and self.special.fullmatch(piece) else len(self.tokenize(_byte_symbols(piece)))
        if len(piece) <= CACHED_CHARS:
            if len(self) >= CACHE_PIECES:
                self.clear()
            self[piece] = n
        return n


class PrefixCounter:
    """Counts for one tokenizer."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = regex.compile("|".join(map(regex.escape, specials))) if specials else None
        self.split = regex.compile(PATTERN)
        self.counts = _PieceCounts(self.tokenizer.model.tokenize, self.special)

    def pieces(self, text: str) -> list[str]:
        """Pieces of ``text``; strings of special tokens are pieces of their own."""
        if self.special is None or not self.special.search(text):
            return self.split.findall(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += self.split.findall(text[at:m.start()])
            out.append(m[0])
            at = m.end()
        return out + self.split.findall(text[at:])

    def index(self, text: str) -> tuple[list[int], list[int]]:
        """Ends of the pieces in code points and the token counts there, both from zero on."""
        pieces = self.pieces(text)
        ends, counts, at, n = [0], [0], 0, 0
        for piece, k in zip(pieces, map(self.counts.__getitem__, pieces)):
            at += len(piece)
            n += k
            ends.append(at)
            counts.append(n)
        return ends, counts

    # --- inside a piece ---------------------------------------------------------------

    @property
    def vocabulary(self) -> dict[str, int]:
        if not hasattr(self, "_vocabulary"):
            self._vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
            self._longest = max(map(len, self._vocabulary))
        return self._vocabulary

    @lru_cache(maxsize=200_000)  # noqa: B019
    def _neighbours(self, a: str, b: str) -> bool:
        """Whether the token strings a, b come out of their own concatenation unchanged."""
        return [t for t, _ in self._merge(a + b)] == [a, b]

    def _merge(self, symbols: str) -> list[tuple[str, tuple[int, int]]]:
        return [(t.value, t.offsets) for t in self.tokenizer.model.tokenize(symbols)]

    def prefix_counts(self, piece: str) -> list[int]:
        """Token count of every prefix of one piece, by code points, from the empty one on."""
        vocabulary, symbols = self.vocabulary, _byte_symbols(piece)
        last, count = [""] * (len(symbols) + 1), [0] * (len(symbols) + 1)
        for end in range(1, len(symbols) + 1):
            for start in range(max(0, end - self._longest), end):
                token = symbols[start:end]
                if token in vocabulary and self._merge(token)[0][0] == token and (start == 0 or self._neighbours(last[start], token)):
                    last[end], count[end] = token, count[start] + 1
                    break
        out, at = [0], 0
        for c in piece:
            at += len(c.encode())
            out.append(count[at])
        return out

    def _restart(self, text: str, ends: list[int], chars: int) -> int:
        """The last piece border before ``chars`` that the text behind it can't move."""
        k = bisect_right(ends, chars) - 1
        while k > 0 and (text[ends[k] - 1].isspace() or ends[k] == chars):
            k -= 1
        return k

    def tokens_at(self, text: str, index: tuple[list[int], list[int]], chars: int) -> int:
        """Exact token count of the first ``chars`` code points."""
        ends, counts = index
        chars = max(0, min(chars, ends[-1]))
        if chars == ends[-1]:
            return counts[-1]
        k = self._restart(text, ends, chars)
        tail = self.pieces(text[ends[k]:chars])
        return counts[k] + sum(1 if self.special and self.special.fullmatch(p) else self.prefix_counts(p)[-1] for p in tail)

    def longest_prefix(self, text: str, index: tuple[list[int], list[int]], budget: int) -> int:
        """The most code points whose own encoding has at most ``budget`` tokens, up to the first longer piece."""
        ends, counts = index
        if counts[-1] <= budget:
            return ends[-1]
        k = bisect_right(counts, budget) - 1
        piece = text[ends[k]:ends[k + 1]]
        if self.special and self.special.fullmatch(piece):
            return ends[k]
        inside = self.prefix_counts(piece)
        best = max(j for j, n in enumerate(inside) if counts[k] + n <= budget)
        return ends[k] + best


@lru_cache(maxsize=1)
def _alphabet() -> dict[int, str]:
    """The printable stand-in of every byte: printable Latin-1 as it is, the others from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(256 + rest.index(b)) for b in rest}


def _byte_symbols(text: str) -> str:
    return text.encode().decode("latin-1").translate(_alphabet())


@lru_cache(maxsize=1)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def prefix_index(docs: DataFrame, path: str) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, piece_ends, piece_counts)``: the exact count at every piece border.

    A missing text is the empty text, with no tokens.  Rows are independent: repeated rows and ids come
    back as often; an empty table stays empty; further columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        c = counter(path)
        for batch in batches:
            rows = [c.index(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array([r[1][-1] for r in rows], pa.int64()),
                 pa.array([r[0] for r in rows], pa.list_(pa.int64())), pa.array([r[1] for r in rows], pa.list_(pa.int64()))],
                names=["doc_id", "n_bytes", "n_tokens", "piece_ends", "piece_counts"])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, piece_ends array<long>, piece_counts array<long>"
    return _sized(docs).mapInArrow(run, schema)


def token_totals(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)``: the index's last count, and whether it has a count above ``limit``.

    Edge cases are those of :func:`prefix_index`.
    """
    counts = F.col("piece_counts")
    return prefix_index(docs, path).select("doc_id", "n_bytes", F.element_at(counts, -1).alias("n_tokens"), F.exists(counts, lambda n: n > limit).alias("over_limit"))


def _sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
