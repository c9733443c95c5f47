"""Cases in which an operator once did less than the whole job."""

import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from ionweave.llm import license_scan, mixing, simhash, token_counts
from ionweave.llm.common import documents

SF = "/root/testdata/sf0.01"

MIT = """/*
 * Permission is hereby granted, free of charge, to any person obtaining a copy
 * of this software and associated documentation files (the "Software"), to deal
 * in the Software without restriction."""
BSD = """# Redistribution and use in source and
# binary forms, with or without
# modification, are permitted provided that
# the following conditions are met:"""


def test_wrapped_notices_are_found(spark):
    code = "".join(f"line {k} of code\n" for k in range(40))
    texts = [MIT, BSD, code + MIT + "\n" + code, code + "one more\n" + BSD, code, "\n".join(BSD.replace("#", " ").split())]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = license_scan.digest(license_scan.scan(docs, license_scan.token_order(docs))).collect()
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in out}
    assert got == {0: ("mit", 1.0), 1: ("bsd", 1.0), 2: ("mit", 1.0), 3: ("bsd", 1.0), 4: ("", 0.0), 5: ("bsd", 1.0)}


def test_a_template_longer_than_the_step_fits_a_block(spark):
    words = [f"w{k}" for k in range(50)]
    for shift in range(0, 40, 3):
        runs = list(license_scan._runs([b"x"] * shift + [w.encode() for w in words] + [b"y"] * 90, 50))
        assert any({w.encode() for w in words} <= set(b) for _, b in runs)
        assert sum(b[-1] == b"y" for _, b in runs) > 0


def shingles(text, n=5):
    w = brute.TOKENS.findall(brute.lower(text))
    return {" ".join(w[i:i + n]) for i in range(max(1, len(w) - n + 1))}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def edited(words, r, k):
    """Every block of words changed once, in k places."""
    out = list(words)
    for at in r.sample(range(len(words)), k):
        out[at] = f"new{r.randrange(10**9)}"
    return out


@pytest.mark.parametrize("set_rows", [3, 512])
def test_only_similar_texts_are_grouped(spark, set_rows):
    r = random.Random(4)
    base = [f"word{r.randrange(5000)}" for _ in range(300)]
    rows = [" ".join(edited(base, r, 12)) for _ in range(14)]  # a template: fingerprints are near, similarity is about 0.66
    chain = [[f"text{r.randrange(5000)}" for _ in range(300)]]
    for _ in range(4):
        chain.append(edited(chain[-1], r, 4))
    rows += [" ".join(w) for w in chain] + [" ".join(chain[0])]
    sets = [shingles(t) for t in rows]
    parent = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= 0.8:
                parent = [min(parent[i], parent[j]) if p in (parent[i], parent[j]) else p for p in parent]
    masks = simhash.sampled_masks(64, 16, 4)
    docs = spark.createDataFrame([(k, t, "own") for k, t in enumerate(rows)], "doc_id long, text string, s0 string")
    got = {x["doc_id"]: x["component_id"] for x in simhash.similar_groups(docs, masks, 56, 5, 0.8, set_rows).collect()}
    assert got == dict(enumerate(parent))
    assert len(set(parent)) == 15
    assert {x["doc_id"] for x in simhash.one_of_each_group(docs).collect()} == set(parent)


def test_alike_matches_brute_force():
    r = np.random.default_rng(8)
    sets = [np.unique(r.choice(40, size)).astype(np.uint64) for size in r.integers(20, 90, 120)] + [np.empty(0, np.uint64)]
    labels = np.arange(len(sets))
    for i in range(len(sets)):
        for j in range(i):
            if jaccard(set(sets[i].tolist()), set(sets[j].tolist()) | set()) >= 0.8 if len(sets[i]) + len(sets[j]) else True:
                a, b = sorted((labels[i], labels[j]))
                labels[labels == b] = a
    assert simhash.alike(sets, 0.8).tolist() == labels.tolist()
    assert 1 < len(set(labels.tolist())) < len(sets)


def test_pipeline_removes_near_copies_only(spark):
    docs = documents(spark, SF)
    sets = {x["doc_id"]: shingles(x["text"]) for x in docs.collect()}
    kept = {x["doc_id"] for x in simhash.one_of_each_group(docs).collect()}
    index = {}
    for d in sorted(sets):
        for s in sets[d]:
            index.setdefault(s, []).append(d)
    pairs = {(a, b) for g in index.values() for i, a in enumerate(g) for b in g[i + 1:] if jaccard(sets[a], sets[b]) >= 0.8}
    assert sets.keys() - kept <= {x for p in pairs for x in p}
    assert sum(a in kept and b in kept for a, b in pairs) <= 0.02 * len(pairs)


def test_small_sources_reach_their_weight(spark):
    rows = [(k, "x" * 20_000, "big") for k in range(100)] + [(1000 + k, "y" * 10, "small") for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    rates = mixing.source_rates(docs, weights={"big": 0.9, "small": 0.1})
    rate = {r["source"]: r["rate"] for r in rates.collect()}
    assert rate["small"] == pytest.approx(0.1 * 2_000_200 / 200)  # about 1000
    counts = {r["doc_id"]: r["n"] for r in mixing.replicate(docs, rates).filter("source = 'small'").groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    n = np.array(list(counts.values()))
    assert len(n) == 20 and len(set(counts.values())) > 10
    assert abs(n.mean() - rate["small"]) < 4 * (rate["small"] / 20) ** 0.5
    assert 0.3 < n.var(ddof=1) / rate["small"] < 2.5


def test_token_totals_come_from_the_index(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "one two three"), (2, ""), (3, None), (4, "word " * 50)], "doc_id long, text string")
    path = token_counts.tokenizer_path()
    index = token_counts.prefix_index(docs, path)
    want = {r["doc_id"]: r["piece_counts"] for r in index.collect()}
    monkeypatch.setattr(token_counts, "prefix_index", lambda d, p: index.withColumn("piece_counts", F.transform("piece_counts", lambda n: n + 1)))
    got = {r["doc_id"]: (r["n_tokens"], r["over_limit"]) for r in token_counts.token_totals(docs, path, limit=4).collect()}
    assert got == {d: (c[-1] + 1, c[-1] + 1 > 4) for d, c in want.items()}
    assert {over for _, over in got.values()} == {True, False}
