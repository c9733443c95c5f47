import numpy as np
import pytest
from pyspark.sql import functions as F

from ionweave.operators import density_tree as T
from ionweave.operators.spectral import spectral_embedding


def brute_leaves(x, ids, min_size):
    """Leaf clusters by merging all pairs in ranked order."""
    n = len(x)
    pairs = sorted((round(float(np.linalg.norm(x[a] - x[b])), 9), min(ids[a], ids[b]), max(ids[a], ids[b]), a, b)
                   for a in range(n) for b in range(a + 1, n))
    part = {i: frozenset([i]) for i in range(n)}
    open_, done = {}, []
    for *_, a, b in pairs:
        p, q = part[a], part[b]
        if p == q:
            continue
        both, leaf = p | q, None
        if len(p) >= min_size and len(q) >= min_size:
            done += [open_[s] for s in (p, q) if open_.get(s)]
        elif len(p) < min_size and len(q) < min_size:
            leaf = set(both) if len(both) >= min_size else None
        else:
            big, small = (p, q) if len(p) >= min_size else (q, p)
            leaf = open_[big] | small if open_.get(big) else None
        open_[both] = leaf
        for i in both:
            part[i] = both
    out = np.full(n, -1)
    for members in done:
        out[list(members)] = min(ids[list(members)])
    return out


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("min_size", [2, 3, 5])
def test_leaves_equal_brute_force(seed, min_size):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(40, 3))
    x = np.concatenate([x, x[:6]])  # copies
    ids = rng.permutation(1000)[:46]
    label = T.tree_clusters(46, T.spanning_tree(x, ids, np.zeros(46)), ids, min_size)
    named = np.array([-1 if c < 0 else ids[label == c].min() for c in label])
    assert (named == brute_leaves(x, ids, min_size)).all()


def test_excess_of_mass_keeps_the_stable_clusters():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(30, 2)) * 0.1, rng.normal(size=(30, 2)) * 0.1 + 5])
    ids = np.arange(60)
    label = T.tree_clusters(60, T.spanning_tree(x, ids, np.zeros(60)), ids, 5, "eom")
    assert len({*label} - {-1}) == 2
    assert len({*label[:30]} & {*label[30:]} - {-1}) == 0


def test_no_split_means_noise():
    x = np.array([[0.0], [1.0], [3.0]])
    ids = np.arange(3)
    assert (T.tree_clusters(3, T.spanning_tree(x, ids, np.zeros(3)), ids, 2) == -1).all()


@pytest.mark.parametrize("min_samples", [1, 3])
def test_large_block_route_equals_single_task(spark, min_samples):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(150, 4))
    x = np.concatenate([x, x[:20], x[:20]])
    ids = rng.permutation(5000)[:190]
    df = spark.createDataFrame([(int(i % 2), int(i), [float(v) for v in r]) for i, r in zip(ids, x)],
                               "part int, vertex long, embedding array<double>")
    one = dict(map(tuple, T.hdbscan_blocks(df, ["part"], min_samples=min_samples).collect()))
    two = dict(map(tuple, T.hdbscan_blocks(df, ["part"], min_samples=min_samples, block_rows=10, tile_rows=40).collect()))
    assert one == two and len(one) == 190


@pytest.mark.parametrize("min_size, method", [(4, "leaf"), (5, "eom")])
def test_contracted_tree_equals_single_task(spark, min_size, method):
    rng = np.random.default_rng(min_size)
    x = np.concatenate([rng.normal(size=(60, 2)), rng.normal(size=(30, 2)) * 0.1 + rng.integers(0, 6, (30, 2)), np.cumsum(rng.random((40, 2)), 0) / 10])
    x = np.concatenate([x, x[:10]])
    ids = rng.permutation(5000)[:len(x)]
    df = spark.createDataFrame([(int(i % 2), int(i), [float(v) for v in r]) for i, r in zip(ids, x)],
                               "part int, vertex long, embedding array<double>")
    one = dict(map(tuple, T.hdbscan_blocks(df, ["part"], min_size, method=method).collect()))
    two = dict(map(tuple, T.hdbscan_blocks(df, ["part"], min_size, method=method, block_rows=10, tile_rows=60).collect()))
    assert one == two and len({*one.values()}) > 2


def test_running_values_cross_slices(spark):
    from ionweave.operators.scan import NEVER, Running, running
    from ionweave.session import sorted_slices

    rng = np.random.default_rng(0)
    rows = [(int(g), i, float(rng.normal()), float(rng.normal()) if rng.random() < 0.3 else NEVER) for i, g in enumerate(np.sort(rng.integers(0, 4, 400)))]
    slices = sorted_slices(spark.createDataFrame(rows, "seg long, i long, add double, least double").repartition(7), "seg", "i")
    got = {r["i"]: r for r in running(slices, "seg", [Running("y", "add", "least"), Running("s", "add")]).collect()}
    seg = y = s = None
    for g, i, add, least in rows:
        if g != seg:
            seg, y, s = g, 0.0, 0.0
        assert (got[i]["y_before"], got[i]["s_before"]) == pytest.approx((y, s))
        y, s = max(least, y + add), s + add
        assert (got[i]["y"], got[i]["s"]) == pytest.approx((y, s))


def test_votes_need_agreement(spark):
    rows = [(1, 0, 7), (2, 0, 7), (1, 1, 8), (2, 1, 8), (3, 0, 7), (3, 1, 9), (4, 2, 5), (5, 2, 5)]
    rows += [(100 + i, r, 50 + r) for i in range(5) for r in range(3)]
    df = spark.createDataFrame(rows, "idx long, rep int, part long")
    out = dict(map(tuple, T.vote_components(df, 2).collect()))
    assert out == {1: 1, 2: 1, **{100 + i: 100 for i in range(5)}}
    assert T.votes_needed(1, 6) == 2 and T.votes_needed(None, 6) == 4


def agreement_want(rows, votes):
    """Smallest row reachable over pairs with enough common parts, by comparing all pairs."""
    sets = {}
    for idx, rep, part in rows:
        sets.setdefault(idx, set()).add((rep, part))
    names = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and len(sets[a] & sets[b]) >= votes and names[a] != names[b]:
                low, high = sorted((names[a], names[b]))
                names = {i: low if n == high else n for i, n in names.items()}
    return {i: n for i, n in names.items() if sum(m == n for m in names.values()) > 1}


@pytest.mark.parametrize("repeats, votes, group_rows", [(20, 10, 2_000), (6, 2, 3), (5, 5, 2), (4, 1, 2), (7, 3, 2)])
def test_agreement_join_equals_all_pairs(spark, repeats, votes, group_rows):
    """Hot parts, copies, rows without some repeats; small ``group_rows`` send large groups through every depth."""
    from ionweave.operators.agreement import agreement_links
    from ionweave.operators.graph import connected_components

    rng = np.random.default_rng(repeats)
    base = rng.integers(0, 40, (12, repeats))
    rows = []
    for i in range(90):
        codes = np.where(rng.random(repeats) < 0.35, rng.integers(0, 40, repeats), base[rng.integers(0, 12)])
        codes[0] = 7 if i % 3 else codes[0]  # one part holds two thirds of the rows
        rows += [(i, r, int(c)) for r, c in enumerate(codes) if rng.random() < 0.95]
    rows += [(200 + i, r, p) for i in range(6) for _, r, p in rows[:repeats] if _ == 0] + rows[:5]
    df = spark.createDataFrame([*rows, (None, 0, 7), (300, 0, None)], "idx long, rep int, part long")
    got = dict(map(tuple, connected_components(agreement_links(df, votes, group_rows)).collect()))
    assert got == agreement_want(rows, votes)


def ring_of_groups(n, size, rng):
    w = np.zeros((n, n))
    for i in range(n):
        for j in range(i + 1, n):
            if rng.random() < (0.4 if i // size == j // size else 0.02) or j == i + 1:
                w[i, j] = w[j, i] = 0.5 + rng.random() / 2
    return w


def edges_of(spark, w, shift=0):
    return spark.createDataFrame([(int(i) + shift, int(j) + shift, float(w[i, j])) for i, j in zip(*np.nonzero(w))],
                                 "i long, j long, w double")


def test_spectral_embedding_equals_dense_eigenvectors(spark):
    w = ring_of_groups(60, 20, np.random.default_rng(2))
    d = w.sum(1)
    _, u = np.linalg.eigh(np.eye(60) - w / np.sqrt(np.outer(d, d)))
    z = u[:, 1:6] / np.linalg.norm(u[:, 1:6], axis=1, keepdims=True)
    got = spectral_embedding(edges_of(spark, w), 5).orderBy("idx").toPandas()
    y = np.stack(got.embedding)
    assert np.abs(y @ y.T - z @ z.T).max() < 1e-8


def test_subspace_route_finds_the_same_space(spark):
    w = np.kron(np.eye(3), np.ones((6, 6))) * 0.9
    np.fill_diagonal(w, 0)
    w[5, 6] = w[6, 5] = w[11, 12] = w[12, 11] = 0.3
    edges = edges_of(spark, w)
    one = np.stack(spectral_embedding(edges, 2).orderBy("idx").toPandas().embedding)
    two = np.stack(spectral_embedding(edges, 2, dense_nodes=4).orderBy("idx").toPandas().embedding)
    assert np.abs(one @ one.T - two @ two.T).max() < 1e-3


def test_large_components_are_solved_together(spark):
    """Two rings and a small clique in one iteration; the smaller ones are locked before the slow ring."""
    from ionweave.operators.spectral import component_eigenpairs, scaled_components

    def ring(n, at):
        return [(at + i, at + (i + s) % n, 1.0) for i in range(n) for s in (1, n - 1)]

    rows = ring(80, 0) + ring(24, 1000) + [(2000 + i, 2000 + j, 1.0) for i in range(6) for j in range(6) if i != j]
    scaled, parts = scaled_components(spark.createDataFrame(rows, "i long, j long, w double"))
    out = component_eigenpairs(scaled, parts, 5, dense_nodes=4).toPandas()
    for at, n in ((0, 80), (1000, 24)):
        got = out[out.component == at]
        want = np.sort(1 - np.cos(2 * np.pi * np.arange(n) / n))[:5]
        assert len(got) == n and np.abs(np.array(got.vals.iloc[0]) - want).max() < 1e-6
        v = np.stack(got.vecs)
        assert np.abs(v.T @ v - np.eye(5)).max() < 1e-6
    assert np.array(out[out.component == 2000].vals.iloc[0]) == pytest.approx([0, 1.2, 1.2, 1.2, 1.2])


def test_iteration_in_a_task_equals_dense_eigenvectors(spark):
    from ionweave.operators.spectral import component_eigenpairs, scaled_components

    edges = edges_of(spark, ring_of_groups(120, 40, np.random.default_rng(4)))
    scaled, parts = scaled_components(edges)
    dense, task = (component_eigenpairs(scaled, parts, 4, **limits).orderBy("idx").toPandas()
                   for limits in ({}, {"dense_nodes": 50, "task_links": 1_000_000}))
    assert np.abs(np.array(dense.vals[0]) - np.array(task.vals[0])).max() < 1e-7
    one, two = np.stack(dense.vecs)[:, :3], np.stack(task.vecs)[:, :3]
    assert np.abs(one @ one.T - two @ two.T).max() < 1e-3


def test_filter_does_not_drown_the_basis_in_the_largest_vector():
    """A random graph: one value of 1 and a dense rest far below it, as neighbour graphs of a large table have."""
    import pyarrow as pa
    from ionweave.operators import spectral

    rng = np.random.default_rng(8)
    w = np.triu(rng.random((600, 600)) < 0.05, 1).astype(float)
    w += w.T
    d = np.maximum(w.sum(1), 1)
    wn = w / np.sqrt(np.outer(d, d))
    i, j = np.nonzero(w)
    got = spectral._task_kernel(12, max_rounds=60)(pa.table({"component": np.zeros(len(i), np.int64), "i": i, "j": j, "wn": wn[i, j]}))
    want = np.sort(1 - np.linalg.eigvalsh(wn))[:12]
    assert np.abs(np.array(got.column("vals")[0].as_py()) - want).max() < 1e-7
    steps = spectral._filter_steps(np.r_[1.0, np.linspace(0.7, 0.69, 40)], 31)
    assert np.cosh(steps * np.arccosh((2 + 0.31) / 1.69)) <= spectral.SUM_GAIN


@pytest.mark.parametrize("dense_nodes", [2_000, 4])
def test_all_pairs_of_a_component_are_found(spark, dense_nodes):
    """Of a path of 45 nodes, more than the k + 1 smallest."""
    from ionweave.operators.spectral import component_eigenpairs, scaled_components

    path = [(i + a, i + b, 1.0) for i in range(44) for a, b in ((0, 1), (1, 0))]
    scaled, parts = scaled_components(spark.createDataFrame(path, "i long, j long, w double"))
    out = component_eigenpairs(scaled, parts, None, dense_nodes).toPandas()
    v = np.stack(out.vecs)
    assert v.shape == (45, 45) and np.abs(v.T @ v - np.eye(45)).max() < 1e-6
    assert sum(out.vals[0]) == pytest.approx(45, abs=1e-5)


def test_iteration_without_enough_rounds_raises(spark):
    from ionweave.operators import spectral

    rows = [(i, (i + s) % 60, 1.0) for i in range(60) for s in (1, 59)]
    scaled, parts = spectral.scaled_components(spark.createDataFrame(rows, "i long, j long, w double"))
    with pytest.raises(spectral.NotConverged):
        spectral.iterated_eigenpairs(scaled, parts.select("component", "n"), 3, max_rounds=1)


def test_components_stay_apart_in_spectral_space(spark):
    w = np.ones((4, 4)) - np.eye(4)
    both = edges_of(spark, w).union(edges_of(spark, w, 10))
    out = spectral_embedding(both, 30)
    assert out.select("component").distinct().count() == 2
    assert out.filter(F.size("embedding") == 0).count() == 0


def test_groups_inside_two_components_are_found(spark):
    # per component two tight groups joined by a weak bridge: the bridge vectors separate them
    w = np.kron(np.eye(2), np.ones((5, 5))) * 0.9
    np.fill_diagonal(w, 0)
    w[4, 5] = w[5, 4] = 0.05
    both = edges_of(spark, w).union(edges_of(spark, w, 20))
    from ionweave.operators.density import density_clusters
    z = spectral_embedding(both, 3)
    label = dict(map(tuple, density_clusters(z, 0.3, 2, ["component"]).select("idx", "label").collect()))
    groups = [range(5), range(5, 10), range(20, 25), range(25, 30)]
    assert [len({label[i] for i in g}) for g in groups] == [1, 1, 1, 1]
    assert len(set(label.values())) == 4


def test_large_written_tables_are_not_sent_through_the_driver(spark, monkeypatch):
    from ionweave import session

    monkeypatch.setattr(session, "BROADCAST_ROWS", 10)
    left, right = (session.written(spark.range(20).selectExpr("id", f"id * 2 AS {name}")) for name in "ab")
    joined = left.join(right, "id")
    assert "SortMergeJoin" in joined._jdf.queryExecution().executedPlan().toString()
    assert joined.count() == 20
    rng = np.random.default_rng(5)
    rows = spark.createDataFrame([(0, i, (rng.normal(size=4) + 6 * (i % 3)).tolist()) for i in range(60)], "label int, vertex long, embedding array<double>")
    found = [sorted(map(tuple, T.hdbscan_blocks(rows, ["label"], 5, method="eom", block_rows=n, tile_rows=16).collect())) for n in (100, 5)]
    assert found[0] == found[1]


def test_all_eigenpairs_in_bands(spark, monkeypatch):
    """Two components wider than a task's matrix: many slabs, parts and blocks, one eigenvalue 59 times."""
    from ionweave.operators import band, spectral

    n, rng = 300, np.random.default_rng(3)
    w = np.triu(rng.uniform(size=(n, n)) * (rng.uniform(size=(n, n)) < 0.03), 1)
    w[200:260, 200:260] = np.triu(np.ones((60, 60)), 1)
    w += np.diag(np.full(n - 1, 0.1), 1)
    i, j = np.nonzero(w + w.T)
    rows = [(int(9000 - 7 * a), int(9000 - 7 * b), float((w + w.T)[a, b])) for a, b in zip(i, j)]
    rows += [(a, a + d, 1.0) for a in range(41) for d in (-1, 1) if 0 <= a + d < 41]
    scaled, parts = spectral.scaled_components(spark.createDataFrame(rows, "i long, j long, w double"))
    whole = band.all_eigenpairs
    monkeypatch.setattr(spectral, "ITERATED_NODES", 30)
    monkeypatch.setattr(band, "NARROWEST", 1e-5)
    monkeypatch.setattr(spectral, "all_eigenpairs", lambda e, s: whole(e, s, band=40, part_pairs=64, searched=160, block_pairs=128))
    blocks = spectral.eigenpair_blocks(scaled, parts, 4).persist()
    found, links = blocks.toPandas(), scaled.toPandas()
    assert sorted(found.groupby("component")["first"].nunique()) == [1, 3]
    for component, own in found.groupby("component"):
        e = links[links.component == component]
        nodes = np.unique(e.i)
        lap = np.eye(len(nodes))
        lap[np.searchsorted(nodes, e.i), np.searchsorted(nodes, e.j)] -= e.wn
        own = [g.sort_values("idx") for _, g in own.groupby("first")]
        vecs, vals = np.hstack([np.stack(g.vecs) for g in own]), np.concatenate([g.vals.iloc[0] for g in own])
        assert all((g.idx.to_numpy() == nodes).all() for g in own)
        np.testing.assert_allclose(vals, np.linalg.eigvalsh(lap), atol=2e-8)
        np.testing.assert_allclose(vecs.T @ vecs, np.eye(len(nodes)), atol=1e-8)
        np.testing.assert_allclose(lap @ vecs, vecs * vals, atol=1e-7)
    errors = spectral.pair_errors(scaled, blocks).toPandas()
    assert len(errors) == n + 41 and errors.r.max() < 1e-6 and errors.q.max() < 1e-7


def test_all_eigenpairs_are_planned_alike_for_any_width(spark, monkeypatch):
    """The plan that the driver holds must not grow with the nodes of a component."""
    from ionweave.operators import spectral

    rows = [(a, a + d, 1.0) for a in range(40) for d in (-1, 1) if 0 <= a + d < 40]
    scaled, parts = spectral.scaled_components(spark.createDataFrame(rows, "i long, j long, w double"))
    asked = []
    monkeypatch.setattr(spectral, "ITERATED_NODES", 30)
    monkeypatch.setattr(spectral, "all_eigenpairs", lambda e, s: asked.append(s.first()["n"]) or spark.createDataFrame(
        [(0, 0, 0, [0.0], [1.0])], "component long, first long, idx long, vals array<double>, vecs array<double>"))
    monkeypatch.setattr(spectral, "iterated_eigenpairs", lambda *a, **k: pytest.fail("one sum per node"))
    spectral.eigenpair_blocks(scaled, parts, 4)
    assert asked == [40]


@pytest.mark.parametrize("size", [(50, 8), (5, 8), (8, 8)])
def test_reflectors_and_shifts(size):
    from ionweave.operators import band

    panel = np.random.default_rng(1).normal(size=size)
    panel[:, 3] = 0
    v, t, r = band.reflectors(panel)
    q = np.eye(size[0]) - v @ t @ v.T
    np.testing.assert_allclose(q @ q.T, np.eye(size[0]), atol=1e-12)
    np.testing.assert_allclose(q[:, :len(r)] @ r, panel, atol=1e-12)
    # the first pivot vanishes at the middle of the part, so the inverse is taken beside it
    m = band.BlockTridiagonal([np.eye(2), np.eye(2)], [np.array([[0.5, 0.1], [0.0, 0.4]])])
    vals = np.linalg.eigvalsh(m.times(np.eye(4)))
    assert m.below(1.0001) == 2
    got, vecs = m.between(1 - 0.70001, 1 + 0.7, 0, 4, 4)
    np.testing.assert_allclose(got, vals, atol=1e-12)
    np.testing.assert_allclose(vecs.T @ vecs, np.eye(4), atol=1e-12)


def test_a_round_is_filtered_alike_in_tasks_and_by_joins(spark, monkeypatch):
    """Two components; by joins each step is a job, in tasks all steps of a round are one."""
    from ionweave.operators import spectral

    rows = [(c * 100 + a, c * 100 + (a + d) % 30, 1.0 + 0.1 * ((a + (a + d) % 30) % 3))
            for c in (0, 1) for a in range(30) for d in (-1, 1, 5, -5)]
    scaled, _ = spectral.scaled_components(spark.createDataFrame(rows, "i long, j long, w double"))
    basis = scaled.select("component", F.col("i").alias("idx")).distinct().select(
        "component", "idx", F.lit(0).alias("slice"), F.lit(1).alias("slices"),
        F.transform(F.sequence(F.lit(1), F.lit(6)), lambda p: F.sin(p * F.col("idx").cast("double"))).alias("y")).persist()
    low = scaled.select("component").distinct().withColumn("low", F.lit(0.2) + F.col("component") / 1000)
    sides, jobs, written = [], [], spectral.written
    for run in (spectral._filtered, spectral._filtered_in_tasks):
        jobs.append(0)
        monkeypatch.setattr(spectral, "written", lambda df: jobs.__setitem__(-1, jobs[-1] + 1) or written(df))
        sides.append(run(scaled, basis, low, 6, 5).orderBy("component", "idx").toPandas())
    assert (sides[0].idx == sides[1].idx).all() and list(sides[0].columns) == list(sides[1].columns)
    np.testing.assert_allclose(np.stack(sides[0].y), np.stack(sides[1].y), atol=1e-12)
    assert jobs == [5, 2]
    monkeypatch.setattr(spectral, "_filtered", lambda *a: pytest.fail("one job per step"))
    sizes = scaled.groupBy("component").agg(F.countDistinct("i").alias("n"))
    assert spectral.iterated_eigenpairs(scaled, sizes, 2).count() == 60
