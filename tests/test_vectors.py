import numpy as np
import pytest
from pyspark.sql import functions as F

from ionweave.config import ClusterConfig
from ionweave.functions import mass as M
from ionweave.operators import clusters as K
from ionweave.operators import graph as G
from ionweave.operators import refine as R
from ionweave.operators import similarity as S
from ionweave.operators.density import density_clusters
from ionweave.operators.tiles import nearest


def unit_rows(n, d, seed, copies=0):
    x = np.random.default_rng(seed).normal(size=(n, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return np.concatenate([x, np.repeat(x[:1], copies, axis=0)])


def frame(spark, x, **extra):
    rows = [(i, [float(v) for v in r], *[extra[k][i] for k in extra]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "idx long, embedding array<double>" + "".join(f", {k} long" for k in extra))


@pytest.mark.parametrize("tile_rows", [4096, 16])
def test_neighbours_equal_brute_force(spark, tile_rows):
    x = unit_rows(120, 6, 1, copies=40)  # a quarter of the rows are copies of one vector
    block = [i % 2 for i in range(len(x))]
    out = nearest(frame(spark, x, b=block), 5, ["b"], tile_rows=tile_rows).select("i", "j").toPandas()
    sim = np.round(np.maximum(x @ x.T, 0), 9)
    want = set()
    for i in range(len(x)):
        order = [j for j in np.lexsort((np.arange(len(x)), -sim[i])) if j != i and block[i] == block[j]]
        want |= {(i, j) for j in order[:5]}
    assert set(zip(out.i, out.j)) == want and len(out) == len(want)


@pytest.mark.parametrize("eps,min_samples,tile_rows", [(0.6, 2, 4096), (0.6, 2, 16), (0.7, 4, 16), (0.5, 1, 16)])
def test_density_equals_brute_force(spark, eps, min_samples, tile_rows):
    x = unit_rows(120, 4, 2, copies=10)
    got = density_clusters(frame(spark, x), eps, min_samples, tile_rows=tile_rows).toPandas().set_index("idx").label
    near = np.linalg.norm(x[:, None] - x[None], axis=2) <= eps
    core = near.sum(1) >= min_samples
    edge = near & (core[:, None] | core[None])
    label = np.arange(len(x))
    for _ in range(len(x)):
        label = np.array([min([label[i], *label[edge[i]]]) for i in range(len(x))])
    label = np.array([v if core[label == v].any() else -1 for v in label])
    assert (got.loc[range(len(x))].values == label).all()


def test_shared_border_row_joins_two_clusters(spark):
    # two dense ends and one row in reach of both, itself not core
    pos = [0.0, 0.1, 0.2, 0.3, 1.25, 2.2, 2.3, 2.4, 2.5]
    df = spark.createDataFrame([(i, [p]) for i, p in enumerate(pos)], "idx long, embedding array<double>")
    out = {r["idx"]: r["label"] for r in density_clusters(df, 0.96, 4).collect()}
    assert set(out.values()) == {0}


def test_components_do_not_depend_on_route_or_order(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 80)] + [(300, 300)]
    df = spark.createDataFrame(links, "src long, dst long")
    one = sorted(map(tuple, G.connected_components(df).collect()))
    flipped = df.select(F.col("dst").alias("src"), F.col("src").alias("dst")).repartition(6)
    two = sorted(map(tuple, G.connected_components(flipped, finish_links=0).collect()))
    assert one == two
    assert {c for _, c in one} == {0, 100}


def test_ppm_rule_is_directed_and_halves_the_edge(spark):
    # the lighter row's tolerance is the smaller one: only the heavier row accepts the pair
    pmz = 500.0 + M.PROTON_MASS
    other = pmz + 500.0 * 10e-6 * 1.000005
    x = [[1.0, 0.0], [1.0, 0.0]]
    df = spark.createDataFrame([(0, x[0], pmz, 1), (1, x[1], other, 1)],
                               "idx long, embedding array<double>, precursor_mz double, precursor_charge int")
    pairs = S.candidate_pairs(df, 1)
    assert [(r["i"], r["j"]) for r in S.directed_edges(pairs, ClusterConfig()).collect()] == [(1, 0)]
    w = {(r["i"], r["j"]): r["w"] for r in S.similarity_graph(df, ClusterConfig(), 2).collect()}
    assert w == {(0, 1): 0.5, (1, 0): 0.5}


def test_hash_graph_finds_what_the_plain_one_finds(spark):
    rng = np.random.default_rng(0)
    base = unit_rows(30, 16, 4)
    x = np.repeat(base, 4, axis=0) + rng.normal(size=(120, 16)) * 0.02
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = frame(spark, x).withColumn("precursor_mz", F.lit(600.0)).withColumn("precursor_charge", F.lit(2))
    cfg = ClusterConfig(edge_threshold=0.9, hd_target_bucket_size=30)
    plain = {tuple(r) for r in S.similarity_graph(df, cfg, 120).select("i", "j").collect()}
    coded = {tuple(r) for r in S.similarity_graph(df, cfg.replace(use_hd_prefilter=True), 120).select("i", "j").collect()}
    assert coded <= plain and len(coded) > 0.9 * len(plain)


def test_modal_charge_tie_goes_to_the_first(spark):
    df = spark.createDataFrame([(1, i, c) for i, c in enumerate([3, 2, 2, 3, 0])], "label long, idx long, precursor_charge int")
    assert K.modal_charges(df, ["label"]).first()["consensus_precursor_charge"] == 3
    none = df.withColumn("precursor_charge", F.lit(0))
    assert K.modal_charges(none, ["label"]).first()["consensus_precursor_charge"] == 0


def test_singletons_and_zero_vectors(spark):
    df = spark.createDataFrame([(1, 0, [0.6, 0.8]), (2, 1, [0.0, 0.0]), (2, 2, [0.0, 0.0])],
                               "label long, idx long, embedding array<double>")
    rows = {r["label"]: r for r in K.cluster_quality(df, ["label"]).collect()}
    assert (rows[1]["quality_score"], rows[1]["confidence"]) == (1.0, "HIGH")
    assert (rows[2]["mean_similarity"], rows[2]["confidence"]) == (0.0, "LOW")


def test_split_never_merges_and_merge_is_transitive(spark):
    x = np.array([[1, 0], [0.99, 0.14], [0, 1], [0.14, 0.99], [-1, 0], [-0.99, 0.14], [0, -1], [0.05, -1]], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = frame(spark, x, label=[0] * 4 + [4] * 4)
    split = {r["idx"]: r["label"] for r in R.dynamic_split(rows, ClusterConfig(), 0.3, 0.04).collect()}
    assert split == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 4, 6: 6, 7: 6}
    chain = frame(spark, np.array([[np.cos(a), np.sin(a)] for a in (0, 0.25, 0.5, 2.0)]), label=[0, 1, 2, 3])
    merged = {r["idx"]: r["label"] for r in R.dynamic_merge(chain, ClusterConfig()).collect()}
    assert merged == {0: 0, 1: 0, 2: 0, 3: 3}
    dense = {r["idx"]: r["label"] for r in R.dense_labels(spark.createDataFrame(
        [(0, 5), (1, -1), (2, 9), (3, 5)], "idx long, label long")).collect()}
    assert dense == {0: 0, 1: -1, 2: 1, 3: 0}
    counts = R.label_changes(rows.select("idx", "label"), spark.createDataFrame([(0, -1)], "idx long, label long")).first()
    assert counts.asDict() == {"clusters_before": 2, "noise_before": 0, "clusters_after": 0, "noise_after": 1}


def test_vector_expressions(spark):
    from ionweave.functions import vectors as V
    row = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<float>, z array<float>").select(
        V.dot("a", "a").alias("d"), V.norm("a").alias("n"), V.unit("a").alias("u"), V.unit("z").alias("zero"),
        V.pack_sign_bits(F.array(F.lit(1.0), F.lit(-1.0), F.lit(0.0), F.lit(2.0))).alias("code"),
        V.cosine_floor(F.lit(1.3)).alias("floor")).first()
    assert (row["d"], row["n"], row["u"], row["zero"], row["code"], row["floor"]) == (25.0, 5.0, [0.6, 0.8], [0.0, 0.0], 9, 0.0)
    assert abs(V.repeat_recall(0.55, 6) - 0.992) < 1e-3 and abs(V.angle_recall(0.0, 6) - 1.0) < 1e-12
    assert [V.hash_bit_count(n) for n in (10, 506_000, 10 ** 12)] == [1, 8, 29]
    assert abs(V.euclidean_radius(0.5) - 1.0) < 1e-12


def test_bin_codes_equal_dense_planes(spark):
    rng = np.random.default_rng(3)
    rows = [(i, int(b), float(v)) for i in range(20) for b, v in zip(rng.choice(72_500, 15, replace=False), rng.random(15))]
    got = {r["idx"]: list(r["codes"]) for r in S.bin_hash_codes(
        spark.createDataFrame(rows, "idx long, bin int, v double").repartition(4), 5, 2, seed=42).collect()}
    for rep in range(2):
        planes = S.hashed_planes(72_500, 5, 42 + rep)
        for i in range(20):
            mine = [(b, v) for j, b, v in rows if j == i]
            bits = sum(v * planes[b] for b, v in mine) > 0
            assert got[i][rep] == int(bits @ (1 << np.arange(5)))


def test_gaussian_codes_equal_plain_signs(spark):
    x = unit_rows(30, 8, 5)
    got = {r["idx"]: list(r["codes"]) for r in S.hash_codes(frame(spark, x), 4, 3, seed=7).collect()}
    for rep in range(3):
        bits = x @ S.gaussian_planes(8, 4, 7 + rep) > 0
        assert [got[i][rep] for i in range(30)] == list(bits @ (1 << np.arange(4)))
