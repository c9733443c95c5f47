"""Vector codes, spelling variants and packing against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from brute import ODD_TEXTS

from ionweave.llm import packing, spelling, vector_codes
from ionweave.llm.common import documents

SF = "/root/testdata/sf0.01"


# --- vector codes -------------------------------------------------------------------


def test_products_are_exact_over_several_limbs():
    r = np.random.default_rng(0)
    for width in (1, 8, 100):
        for top in (10, 2**20, vector_codes.largest_integer(width)):
            a, b = (r.integers(-top, top + 1, (40, width)) for _ in range(2))
            a[0], b[0] = top, -top
            want = [[sum(x * y for x, y in zip(p, q)) for q in b.tolist()] for p in a.tolist()]
            assert vector_codes.exact_dot(a, b).tolist() == want
            bits = vector_codes.limb_bits(width)
            assert width * 2 ** (2 * bits) <= 2**53
            parts = vector_codes.limbs(a, bits)
            assert sum(p.astype(np.int64).astype(object) * 2 ** (bits * i) for i, p in enumerate(parts)).tolist() == a.tolist()
    assert len(vector_codes.limbs(np.array([[2**28]]), vector_codes.limb_bits(8))) == 2


def plain_codes(rows):
    """Whole numbers and lists only: rows are (vec_id, label, vector)."""
    kept = [(v, lab, [math.floor(4096 * x) for x in vec]) for v, lab, vec in rows if vec is not None and all(x is not None and math.isfinite(x) for x in vec)]
    if not kept:
        return []
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:16]
    size = len(kept[0][2]) // 8
    part = lambda v, k: v[k * size:(k + 1) * size]
    books = [[part(r[2], k) for r in first] for k in range(8)]

    def near(v, k):
        return min((sum((a - b) ** 2 for a, b in zip(part(v, k), e)), i) for i, e in enumerate(books[k]))

    for _ in range(6):
        new = [list(b) for b in books]
        for k in range(8):
            mine = defaultdict(list)
            for _, _, v in kept:
                mine[near(v, k)[1]].append(part(v, k))
            for e, parts in mine.items():
                new[k][e] = [sum(c) // len(parts) for c in zip(*parts)]
        books = new
    found = [[near(v, k) for k in range(8)] for _, _, v in kept]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    errors = Counter()
    for (_, lab, _), f in zip(kept, found):
        errors[lab] += sum(d for d, _ in f)
    return [(v, "".join(f"{i:02x}" for _, i in f), sum(d for d, _ in f), errors[lab], sha) for (v, lab, _), f in zip(kept, found)]


VECTORS = "vec_id long, embedding array<float>, label int, code string, error string, ints string"


def vector_frame(spark, rows):
    return spark.createDataFrame([(v, e, lab, "c", "e", "i") for v, lab, e in rows], VECTORS)


def odd_vectors():
    r, f = random.Random(2), lambda x: float(np.float32(x))
    rows = [(i, i % 4 or None, [f(r.choice([r.gauss(0, 0.3), r.choice([0, 0.25, -1e-5, 30000.5])])) for _ in range(16)]) for i in range(60)]
    rows += [(7, 1, rows[7][2])] * 2 + [(None, 2, rows[3][2]), (None, None, [0.0] * 16)]
    nan, inf = float("nan"), float("inf")
    return rows + [(100, 1, None), (101, 1, [None] + [0.0] * 15), (102, 1, [nan] + [0.0] * 15), (-1, 1, [-inf] + [0.0] * 15), (-2, None, [])][:-1]


def test_codes_match_plain_version(spark):
    rows = odd_vectors()
    got = vector_codes.compressed(vector_frame(spark, rows).repartition(5))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(plain_codes(rows), key=repr)
    few = rows[:5] + [(9, 3, rows[0][2])]
    assert sorted(map(tuple, vector_codes.compressed(vector_frame(spark, few)).collect()), key=repr) == sorted(plain_codes(few), key=repr)


def test_no_vectors_and_unusable_ones(spark):
    none = vector_frame(spark, [(1, 1, None), (2, None, [None] * 8)])
    assert vector_codes.compressed(none).count() == 0
    assert vector_codes.compressed(none.limit(0)).dtypes == vector_codes.compressed(vector_frame(spark, odd_vectors())).dtypes
    for bad in ([0.0] * 7, [0.0] * 16):
        with pytest.raises(ValueError, match="components"):
            vector_codes.compressed(vector_frame(spark, [(1, 1, [0.0] * 8 if len(bad) == 16 else bad), (2, 1, bad)]))
    with pytest.raises(Exception, match="would not fit"):
        vector_codes.compressed(vector_frame(spark, [(1, 1, [1e9] * 8)]))


def test_vectors_of_codes_are_near_the_originals(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = vector_codes.integer_vectors(vectors)
    books = vector_codes.train(rows)
    back = vector_codes.decode(vector_codes.encode(rows, books), books)
    assert back.columns == ["vec_id", "label", "code", "error", "embedding"]
    real = {r["vec_id"]: np.array(r["embedding"]) for r in vectors.collect()}
    for r in back.collect():
        gap = ((real[r["vec_id"]] - np.array(r["embedding"])) ** 2).sum()
        assert gap == pytest.approx(r["error"] / 4096**2, rel=0.01)


# --- spelling variants --------------------------------------------------------------


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def random_words(seed, n, letters="abà"):
    r = random.Random(seed)
    return {"".join(r.choice(letters) for _ in range(r.randrange(0, 9))) for _ in range(n)} - {""}


@pytest.mark.parametrize("words", [
    random_words(1, 300) | {"a" * n for n in range(1, 12)}, {"x"}, set(),
    {"abc", "abcd", "abd", "bc", "aabc", "abcc"} | {"le" + "s" * k + t for k in range(4) for t in ("", "x", "xy", "sxy")}])
def test_walk_finds_all_near_words_and_no_others(spark, words):
    got = spelling.near_pairs(spark.createDataFrame([(w, "x") for w in words], "word string, gap string")).collect()
    pairs = [tuple(sorted((r["a"], r["b"]))) for r in got]
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == {(a, b) for a in words for b in words if a < b and near(a, b)}


def plain_variants(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    forms, out = {}, []
    for w, n in words.items():
        others = [o for o in words if near(w, o)]
        best = min(others, key=lambda o: (-words[o], o), default=None)
        forms[w] = (best if best and words[best] >= 2 * n else None, len(others))
    for w, n in words.items():
        root = w
        while forms[root][0]:
            root = forms[root][0]
        form = forms[w][0]
        out.append((w, form, root, n, forms[w][1], words[form] if form else None))
    return sorted(out, key=repr)


def test_variants_match_plain_version(spark, monkeypatch):
    r = random.Random(6)
    base = ["Garden", "gardens", "gardeny", "gardensy", "träume", "Träume", "tr×ume", "ÀÉÎÕÜ", "àéîõü", "letterr", "letter", "short", "abcd", "x" * 18, "x" * 19]
    text = lambda: "".join(r.choice([*base[:6], *base]) + r.choice(" ,.\n1日̈") for _ in range(r.randrange(1, 120)))
    rows = [(i, text()) for i in range(150)] + [(None, text()), (None, None), (3, ""), (3, base[0] + " "), (3, base[0] + " ")] + list(enumerate(ODD_TEXTS))
    rows += [(1000, "garden letter " * 3000)]
    docs = spark.createDataFrame([(i, t, "w", 1) for i, t in rows], "doc_id long, text string, word string, n int")
    want = plain_variants(rows)
    assert sum(1 for w in want if w[1]) > 3 and any(w[1] and w[2] != w[1] for w in want)
    monkeypatch.setattr(spelling, "SLICE_CHARS", 50)
    got = spelling.variants(docs)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert spelling.variants(docs.limit(0)).count() == 0


# --- packing ------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_ids_match_the_library(library):
    r = random.Random(1)
    parts = [chr(i) for i in range(33, 127)] * 3 + list("  \t\n\x0b\x0c\r\x1c\x1f\x00\x7f\x85\xa0éÉÜßΣσςİ́ﬁ１٣中文 　×÷<|>'sS")
    parts += ["<|endoftext|>", "<|startoftext|>", "'s", "'RE", "'ll", "'LL ", "straße", "Éclair", "word" * 20]
    for text in ["".join(r.choice(parts) for _ in range(r.randrange(0, 40))) for _ in range(3000)]:
        assert np.frombuffer(packing.text_ids(text, packing.tokenizer_path()), "<u4").tolist() == library(text)


def test_best_fit_takes_the_fullest_bin():
    r = random.Random(4)
    for length in (1, 7, 64, 2048):
        sizes = [r.randrange(1, length + 1) for _ in range(300)]
        bins, want = [], []
        for s in sizes:
            room = min((length - b for b in bins if b + s <= length), default=None)
            want.append(room if room is not None else length)
            if room is None:
                bins.append(s)
            else:
                bins[bins.index(length - room)] += s
        at, offset = packing.best_fit(np.array(sizes), length)
        assert [length - o for o in offset.tolist()] == want
        assert sorted(np.bincount(at, sizes).astype(int).tolist()) == sorted(bins)


def check_packing(rows, length):
    """Sequences without gaps, within ``length``; returns their number."""
    held = defaultdict(list)
    for r in rows:
        held[r[0]].append((r[1], r[2]))
    for places in held.values():
        at = 0
        for offset, size in sorted(places):
            assert offset == at
            at += size
        assert at <= length
    return len(held)


@pytest.mark.parametrize("group", [20, 300, 10_000])
def test_rounds_pack_everything_well(spark, group):
    r = random.Random(7)
    sizes = [r.choice([r.randrange(1, 100), r.randrange(1, 40), 55]) for _ in range(3000)]
    items = spark.createDataFrame(list(enumerate(sizes)), "item long, size int")
    placed = [(b, o, sizes[i]) for i, b, o in packing.pack(items, 100, group, 1).collect()]
    assert len(placed) == len(sizes)
    n = check_packing(placed, 100)
    at, _ = packing.best_fit(np.array(sorted(sizes, reverse=True)), 100)
    assert n <= (at.max() + 1) * (1.0 if group == 10_000 else 1.03 if group == 300 else 1.12)


def test_items_that_never_fit_together_end_the_rounds(spark):
    items = spark.range(500).selectExpr("id AS item", "60 AS size")
    assert packing.pack(items, 100, 20).select("bin").distinct().count() == 500
    assert packing.pack(items.limit(0), 100, 20).count() == 0


def test_packed_documents(spark, library):
    rows = [(r["doc_id"], r["text"]) for r in documents(spark, SF).select("doc_id", "text").collect()]
    rows += [(None, "no id"), (None, None), (5, ""), (5, ""), (2000, "word " * 5000), (2001, "a " * 2047), (2002, "a " * 2048)] + [(3000 + i, t) for i, t in enumerate(ODD_TEXTS)]
    docs = spark.createDataFrame([(d, t, 1, "b") for d, t in rows], "doc_id long, text string, item int, bin string")
    out = packing.packed_documents(docs.repartition(3), packing.tokenizer_path())
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    got = out.collect()
    want, total = [], 0
    for d, t in rows:
        ids = library(t or "") + [0]
        total += len(ids)
        for k in range(0, len(ids), 2048):
            cut = ids[k:k + 2048]
            want.append((d, k // 2048, k, len(cut), zlib.crc32(np.array(cut, "<u4").tobytes())))
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
    n = check_packing([(r["sequence_id"], r["offset"], r["length"]) for r in got], 2048)
    assert n <= math.ceil(total / 2048) * 1.01 + 1
    assert packing.packed_documents(docs.limit(0), packing.tokenizer_path()).count() == 0
