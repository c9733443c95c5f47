import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ionweave.operators import mass_groups as W


def plain_anchor(masses, ppm):
    out, anchor = [], None
    for m in masses:
        if anchor is None or m - anchor > anchor * ppm * 1e-6:
            anchor = m
        out.append(anchor)
    return np.array(out)


def test_chain_splits_by_anchor_but_not_by_gap(spark):
    rows = spark.createDataFrame([(1, i, m) for i, m in enumerate([100.0, 100.0005, 100.0012, 200.0])],
                                 "label long, idx long, mass double")
    def groups(df):
        return [r["grp"] for r in W.number_rows(df).orderBy("idx").collect()]
    assert groups(W.anchored_groups(rows, 10.0)) == [0, 0, 1, 2]
    assert groups(W.gap_groups(rows, 0.5)) == [0, 0, 0, 1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 400)), min_size=1, max_size=60), st.integers(1, 9))
def test_walks_in_slices_equal_one_walk(pairs, width):
    pairs = sorted(set(pairs))
    label = np.array([p[0] for p in pairs])
    mass = np.array([500 + p[1] * 0.001 for p in pairs])
    want = np.concatenate([plain_anchor(mass[label == x], 10) for x in np.unique(label)])
    got, carry = [], None
    for at in range(0, len(pairs), width):
        starts, carry = W.walk_anchor(label[at:at + width], mass[at:at + width], 10, carry)
        got.append(starts)
    assert np.array_equal(np.concatenate(got), want)
    got, carry = [], None
    for at in range(0, len(pairs), width):
        starts, carry = W.walk_gap(label[at:at + width], mass[at:at + width], 0.004, carry)
        got.append(starts)
    whole, _ = W.walk_gap(label, mass, 0.004, None)
    assert np.array_equal(np.concatenate(got), whole)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 300), min_size=1, max_size=80, unique=True), st.integers(1, 30), st.sampled_from([1e-3, 1e-4, 0.0037]))
def test_slices_as_functions_equal_one_walk(places, width, unit):
    mass = np.sort(np.array([500 + p * unit for p in places]))
    for rule, want in ((W.AnchorRule(10), plain_anchor(mass, 10)), (W.GapRule(unit * 1.5), W.walk_gap(np.zeros(len(mass), int), mass, unit * 1.5, None)[0])):
        carry = None
        for at in range(0, len(mass), width):
            part = mass[at:at + width]
            _, alone = rule.walk(np.zeros(len(part), int), part, None)
            whole = not rule.breaks(part)
            entries, anchors = rule.steps(part) if whole else ([], [])
            row = {"first": part[0], "start": alone.start, "entries": entries, "anchors": anchors}
            carry = W.Open(0, rule.hand(row, carry) if carry is not None and whole else alone.start, float(part[-1]))
            assert carry.start == want[min(at + width, len(mass)) - 1]


def test_dense_cluster_over_64_slices_takes_one_collect(spark, no_coalescing, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    df = spark.range(20_000).selectExpr("7L AS label", "id AS idx", "500 + id * 0.00001D AS mass")
    slices, calls, collect = df.repartitionByRange(64, "mass").sortWithinPartitions("mass").checkpoint(), [], DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda self: calls.append(1) or collect(self))
    out = W._slice_starts(slices.select("label", "mass"), W.AnchorRule(10.0))
    assert len(calls) == 1 and slices.rdd.getNumPartitions() == 64
    rows = sorted((r["mass"], r["start"]) for r in collect(out))
    assert np.array_equal([s for _, s in rows], plain_anchor([m for m, _ in rows], 10))


@pytest.fixture()
def no_coalescing(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_one_hot_label_over_many_slices(spark, no_coalescing):
    rng = np.random.default_rng(3)
    rows = [(7 if rng.random() < 0.9 else int(rng.integers(3)), i, float(np.round(500 + rng.random(), 4)))
            for i in range(6000)]
    df = spark.createDataFrame(rows, "label long, idx long, mass double")
    out = W.number_rows(W.anchored_groups(df, 10.0)).toPandas()
    for _, part in out.groupby("label"):
        part = part.sort_values(["mass", "idx"])
        assert np.array_equal(part["start"].values, plain_anchor(part["mass"].values, 10))
        assert part["grp"].iloc[0] == 0
        assert np.array_equal(np.diff(part["grp"].values), (np.diff(part["start"].values) > 0).astype(int))


def test_rows_without_a_precursor_stand_alone(spark):
    df = spark.createDataFrame([(1, 0, -1.0), (1, 1, -1.0), (1, 2, 5.0), (1, 3, 5.0)], "label long, idx long, mass double")
    out = {r["idx"]: r["grp"] for r in W.number_rows(W.anchored_groups(df, 10.0)).collect()}
    assert out == {0: 0, 1: 1, 2: 2, 3: 2}


def test_group_span_is_within_tolerance(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(int(i % 5), i, float(800 + rng.random() * 0.2)) for i in range(2000)],
                               "label long, idx long, mass double")
    from pyspark.sql import functions as F
    span = W.anchored_groups(df, 10.0).groupBy("label", "start").agg((F.max("mass") - F.min("mass")).alias("span"))
    assert span.filter(F.col("span") > F.col("start") * 1e-5).count() == 0
