"""Elias-Fano tries and language-model scores against plain versions."""

import math
import zlib
from collections import Counter

import brute
import numpy as np
import pytest
from brute import ODD_TEXTS

from ionweave.llm import elias_fano, lm_score
from ionweave.llm.common import documents


@pytest.mark.parametrize("universe", [1 << 64, 1 << 20, 100_000])
@pytest.mark.parametrize("n", [0, 1, 3, 1000, 70_000])
def test_elias_fano_round_trip_and_search(universe, n):
    r = np.random.default_rng(n)
    values = np.unique(r.integers(0, min(universe, 1 << 63), n, dtype=np.uint64) * np.uint64(2 if universe == 1 << 64 else 1))
    ef = elias_fano.EliasFano(values, universe)
    assert (ef.values() == values).all()
    directory = ef.directory()
    assert (ef.find(values, directory) == np.arange(len(values))).all()
    other = r.integers(0, min(universe, 1 << 63), 500, dtype=np.uint64)
    want = np.where(np.isin(other, values), np.searchsorted(values, other), -1)
    assert (ef.find(other, directory) == want).all()
    if n == 70_000 and universe == 1 << 64:
        assert ef.nbytes() < 7 * n


def bigram_scores(rows, mu=lm_score.MU):
    docs = {d: [*brute.TOKENS.findall(brute.lower(t)), None] for d, t in rows}
    train = [w for d, w in docs.items() if zlib.crc32(str(d).encode()) % 5 != 1]
    one, two = Counter(), Counter()
    for w in train:
        one.update(w)
        two.update(zip(["<", *w], w))
    n, v = sum(one.values()), len(one)
    context = Counter(one)
    context["<"] = len(train)
    return {d: sum(math.log10((two[c, x] + mu * (one[x] + 0.5) / (n + 0.5 * (v + 1))) / (context[c] + mu)) for c, x in zip(["<", *w], w)) for d, w in docs.items()}


def check(found, rows):
    want, scores = brute.lm_base(rows), bigram_scores(rows)
    got = {r["doc_id"]: r for r in found.collect()}
    assert got.keys() == want.keys()
    for d, (held, n, known, total, base) in want.items():
        r = got[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        assert r["score"] == pytest.approx(scores[d], rel=0.02, abs=0.3)
    return got


@pytest.mark.parametrize("tokens_per_shard", [4_000_000, 20_000])
def test_scores_match_brute_force(spark, tokens_per_shard):
    docs = documents(spark, "/root/testdata/sf0.01")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = check(lm_score.score_documents(docs, tokens_per_shard=tokens_per_shard), rows)
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)  # contexts help on texts not learned from


def test_odd_rows(spark):
    rows = list(enumerate(ODD_TEXTS))
    docs = spark.createDataFrame([(i, t, 1.5) for i, t in rows], "doc_id long, text string, score double")
    check(lm_score.score_documents(docs), rows)
    assert lm_score.score_documents(docs.limit(0)).count() == 0
    only_held = docs.filter("false").union(spark.createDataFrame([(d, "a b", 0.0) for d in range(40) if zlib.crc32(str(d).encode()) % 5 == 1], docs.schema))
    assert all(r["n_known"] == 0 and r["train_tokens"] == 0 for r in lm_score.score_documents(only_held).collect())
    twice = docs.union(docs).union(spark.createDataFrame([(None, "no id", 0.0)], docs.schema))
    assert lm_score.score_documents(twice).count() == 2 * len(rows) + 1
