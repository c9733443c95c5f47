"""SimHash near-dedup against plain versions."""

import random

import brute
import numpy as np
import pytest
from brute import ODD_TEXTS

from ionweave.llm import simhash
from ionweave.llm.common import documents


def test_bit_sliced_distances():
    r = np.random.default_rng(3)
    for width, radius in ((1, 3), (1, 20), (4, 90), (4, 110)):
        base = r.integers(0, 2**63, (1, width), dtype=np.uint64)
        rows = np.where(r.random((700, width)) < 0.5, base ^ (np.uint64(1) << r.integers(0, 64, (700, width), dtype=np.uint64)), r.integers(0, 2**63, (700, width), dtype=np.uint64))
        planes = simhash._planes(rows)
        for lag in (1, 5, 63, 64, 65, 200, 640):
            index = np.arange(700)
            got = simhash.within_radius(planes, lag, simhash._packed(index + lag < 700, 11), radius)
            want = [i for i in range(700 - lag) if sum(int(a ^ b).bit_count() for a, b in zip(rows[i], rows[i + lag])) <= radius]
            assert sorted(got.tolist()) == want


def test_complete_masks_cover_the_radius():
    r = random.Random(5)
    masks = [m[0] for m in simhash.complete_masks(3, 6)]
    assert len(masks) == 20
    for _ in range(500):
        flips = sum(1 << b for b in r.sample(range(64), 3))
        assert any(not flips & m for m in masks)


def rows_of(df):
    return sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in df.collect()), key=repr)


def want_of(rows):
    prints = [brute.fingerprint(t) for _, t in rows]
    ids = [d for d, _ in rows]
    return sorted(zip(ids, [f"{p:016x}" for p in prints], brute.components(ids, prints)), key=repr)


def test_matches_brute_force(spark):
    docs = documents(spark, "/root/testdata/sf0.01")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    want = want_of(rows)
    assert rows_of(simhash.near_duplicates(docs)) == want
    assert sum(a != c for a, _, c in want) > 5


def test_odd_rows(spark):
    rows = [(i, t) for i, t in enumerate([*ODD_TEXTS, "one two three four five six seven eight nine ten eleven twelve thirteen", None])]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fingerprint string")
    assert rows_of(simhash.near_duplicates(docs)) == want_of(rows)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    double = docs.union(spark.createDataFrame([(None, "alone with no id at all", "x"), (2, " ", "x")], docs.schema))
    assert simhash.near_duplicates(double).count() == len(rows) + 2


@pytest.mark.parametrize("tile_rows", [16, 4096])
def test_large_blocks_are_tiled(spark, tile_rows):
    r = random.Random(1)
    base = r.getrandbits(64)
    prints = sorted({base ^ (1 << r.randrange(20)) ^ (1 << r.randrange(20)) for _ in range(300)} | {r.getrandbits(64) for _ in range(200)})
    nodes = spark.createDataFrame([(k, simhash._signed(p)) for k, p in enumerate(prints)], "node long, f0 long")
    links = simhash.near_links(nodes, simhash.complete_masks(3, 6), 3, tile_rows).collect()
    labels = simhash.smallest_labels(len(prints), np.array([x["src"] for x in links]), np.array([x["dst"] for x in links]))
    assert labels.tolist() == brute.components(list(range(len(prints))), prints)
    assert all((prints[x["src"]] ^ prints[x["dst"]]).bit_count() <= 3 or labels[x["src"]] == labels[x["dst"]] for x in links)


def test_wide_fingerprints_find_edited_copies(spark):
    r = random.Random(2)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    texts = [" ".join(r.choice(vocabulary) for _ in range(r.randrange(60, 400))) for _ in range(150)]
    rows, copies = [(k, t) for k, t in enumerate(texts)], {}
    for k, t in enumerate(texts[:100]):
        words = t.split()
        for at in r.sample(range(len(words)), max(1, len(words) // 60)):
            words[at] = "changed"
        a, b = ({" ".join(w[i:i + 5]) for i in range(len(w) - 4)} for w in (t.split(), words))
        copies[1000 + k] = len(a & b) / len(a | b)
        rows.append((1000 + k, " ".join(words)))
    docs = spark.createDataFrame([(*x, "s") for x in rows], "doc_id long, text string, component_id string")
    kept = {x["doc_id"] for x in simhash.one_of_each_group(docs).collect()}
    near = [k for k, j in copies.items() if j >= 0.8]
    assert len(near) > 60
    assert {k for k, _ in rows if k < 1000} <= kept
    assert sum(k not in kept for k in near) >= 0.93 * len(near)
