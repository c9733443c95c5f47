import numpy as np
from pyspark.sql import functions as F

from ionweave.config import ClusterConfig
from ionweave.functions import mass as M
from ionweave.functions import peaks as P
from ionweave.functions import scoring
from ionweave.operators import peak_tables as PT
from ionweave.operators.encode import (encode, encode_projection, projection_matrix, random_parameters,
                                       transformer_forward)


def spectra(spark, seed=0, n=20):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        k = int(rng.integers(3, 30))
        rows.append((i, 400.0 + i, int(i % 4), [float(np.float32(v)) for v in rng.uniform(60, 1400, k)],
                     [float(np.float32(v)) for v in rng.integers(1, 50, k)]))
    return spark.createDataFrame(rows, "idx long, precursor_mz double, precursor_charge int, mz array<float>, intensity array<float>")


def test_array_and_table_forms_agree(spark):
    df = spectra(spark)
    table = PT.explode_peaks(df)
    good = {r["idx"] for r in df.filter(P.passes_quality()).collect()}
    assert good == {r["idx"] for r in PT.quality_filter(table).collect()}
    kept = df.select("idx", F.explode(P.without_precursor(P.zipped(), tol=40.0)).alias("p")).select("idx", "p.mz")
    also = PT.remove_precursor_peaks(table, df, 40.0).select("idx", "mz")
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, also.collect()))
    assert kept.count() < table.count()
    tokens = df.select("idx", F.posexplode(P.tokens(P.zipped(), 10)).alias("pos", "t")).select("idx", "pos", "t.norm_mz", "t.norm_int")
    assert sorted(map(tuple, tokens.collect())) == sorted(map(tuple, PT.peak_tokens(table, 10).collect()))
    bins = (df.select("idx", F.explode(P.binned(P.zipped(), 10)).alias("b")).groupBy("idx", "b.bin").agg(F.max("b.v").alias("v")))
    assert sorted(map(tuple, bins.collect())) == sorted(map(tuple, PT.bin_spectra(table, 10).collect()))


def test_bin_edges(spark):
    df = spark.createDataFrame([(1, 49.99, 1.0), (1, 49.97, 1.0), (1, 1500.0, 1.0)], "idx long, mz double, intensity double")
    assert [r["bin"] for r in PT.bin_spectra(df).collect()] == [0]


def test_consensus_scale_and_weights(spark):
    peaks = spark.createDataFrame(
        [(1, 100.001, 4.0), (1, 200.001, 1.0), (2, 100.003, 9.0), (2, 300.001, 0.00000001), (3, 500.0, 0.0)],
        "idx long, mz double, intensity double")
    members = spark.createDataFrame([(7, 1, 1.0), (7, 2, 3.0), (7, 3, 5.0)], "cluster_id long, idx long, weight double")
    rows = {r["bin"]: r for r in PT.consensus_peaks(members, peaks).collect()}
    assert max(r["intensity"] for r in rows.values()) == 999.0
    low = rows[2500]
    assert abs(low["mz"] - (1 * 100.001 + 3 * 100.003) / 4) < 1e-9
    assert abs(rows[7500]["intensity"] - 0.5 / 4 * 999) < 1e-9
    assert 12500 not in rows and 22500 not in rows  # below one count; spectrum without intensity


def test_fragment_confirmation_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    delta, tol = 15.9949, 0.02
    a = [np.sort(rng.choice(np.arange(100, 400, 0.01), 30)) for _ in range(12)]
    b = [np.concatenate([x[:10] + rng.uniform(-0.025, 0.025, 10), x[10:20] + delta + rng.uniform(-0.025, 0.025, 10)]) for x in a]
    rows = [(i, float(m), 1.0) for i, x in enumerate(a) for m in [*x, x[0]]] + [(100 + i, float(m), 1.0) for i, x in enumerate(b) for m in x]
    peaks = spark.createDataFrame(rows, "idx long, mz double, intensity double")
    pairs = spark.createDataFrame([(i, i, 100 + i, delta) for i in range(12)] + [(50, 3, 999, delta)],
                                  "pair_id long, idx_a long, idx_b long, delta double")
    got = {r["pair_id"]: (r["unshifted"], r["shifted"]) for r in PT.fragment_confirmation(pairs, peaks).collect()}
    for i in range(12):
        ms = [*a[i], a[i][0]]
        plain = sum(bool((np.abs(b[i] - m) <= tol).any()) for m in ms)
        moved = sum(bool((np.abs(b[i] - (m + delta)) <= tol).any() or (np.abs(b[i] - (m - delta)) <= tol).any()) for m in ms)
        assert got[i] == (plain, moved)
    assert got[50] == (0, 0)


def test_scalar_rules(spark):
    row = spark.range(1).select(
        M.neutral_mass(F.lit(501.007276), F.lit(0)).alias("m0"), M.neutral_mass(F.lit(501.007276), F.lit(2)).alias("m2"),
        M.modification_name(F.lit(15.98)).alias("ox"), M.modification_name(F.lit(3.0)).alias("none"),
        M.precursor_score(F.lit(500.0), F.lit(2), F.lit(500.75), F.lit(0), 1.5).alias("half"),
        M.precursor_score(F.lit(500.0), F.lit(2), F.lit(500.0), F.lit(3), 1.5).alias("clash"),
        scoring.quality(F.lit(1.0)).alias("q"), scoring.confidence(F.lit(0.5)).alias("conf")).first()
    assert abs(row["m0"] - 500) < 1e-9 and abs(row["m2"] - 1000) < 1e-9
    assert (row["ox"], row["none"], row["half"], row["clash"], row["q"], row["conf"]) == ("Oxidation", "", 0.5, 0.0, 1.0, "MEDIUM")
    epochs = spark.range(30).select("id", scoring.learning_rate_column("id", 30, 1e-3, 5).alias("lr"),
                                    scoring.uniformity_weight_column("id", 0.15, 5).alias("u")).collect()
    for r in epochs:
        assert abs(r["lr"] - scoring.learning_rate(r["id"], 30, 1e-3, 5)) < 1e-15
        assert abs(r["u"] - scoring.uniformity_weight(r["id"], 0.15, 5)) < 1e-15


def test_projection_equals_dense_product(spark):
    cfg = ClusterConfig(embed_dim=16, top_k_peaks=12)
    df = spectra(spark)
    got = np.stack(encode_projection(df, cfg).orderBy("idx").toPandas().embedding)
    proj = projection_matrix(cfg)
    for r, vec in zip(df.orderBy("idx").collect(), got):
        mz, inten = np.array(r["mz"], float), np.array(r["intensity"], float)
        top = np.lexsort((mz, -inten))[:12]
        dense = np.zeros(cfg.n_bins)
        np.maximum.at(dense, ((mz[top] - 50) / 0.02).astype(int), np.sqrt(inten[top] / inten.max()))
        want = dense @ proj
        assert np.allclose(vec, want / np.linalg.norm(want), atol=1e-6)


def test_transformer_is_unit_and_ignores_padding(spark):
    cfg = ClusterConfig(embed_dim=16, ff_dim=16, n_heads=2)
    par = random_parameters(cfg)
    tokens = np.random.default_rng(0).random((3, 5, 2))
    pad = np.zeros((3, 5), bool)
    pad[1, 3:] = True
    pad[2] = True
    out = transformer_forward(tokens, pad, par, 2)
    longer = transformer_forward(np.concatenate([tokens, np.ones((3, 4, 2))], 1), np.concatenate([pad, np.ones((3, 4), bool)], 1), par, 2)
    assert np.allclose(out, longer) and np.allclose(np.linalg.norm(out, axis=1), [1, 1, 0])
    shuffled = transformer_forward(tokens[:, ::-1], pad[:, ::-1], par, 2)
    assert np.allclose(out, shuffled)
    got = encode(spectra(spark), cfg.replace(use_transformer=True))
    assert got.count() == 20 and len(got.first()["embedding"]) == 16


def plain_encoder(tokens, par, heads):
    """One spectrum at a time and one query token at a time, without padding, batches or masks."""
    def normal(x, name):
        return np.array([(r - r.mean()) / np.sqrt(r.var() + 1e-5) for r in x]) * par[name + ".weight"] + par[name + ".bias"]

    def affine(x, weight, bias):
        return np.array([par[weight] @ r + par[bias] for r in x])

    x, layer = affine(tokens, "input_proj.weight", "input_proj.bias"), 0
    while f"encoder.layers.{layer}.norm1.weight" in par:
        p = f"encoder.layers.{layer}."
        qkv = affine(normal(x, p + "norm1"), p + "self_attn.in_proj_weight", p + "self_attn.in_proj_bias")
        d = x.shape[1]
        size, mixed = d // heads, np.zeros_like(x)
        for h in range(heads):
            q, k, v = (qkv[:, at * d + h * size:at * d + (h + 1) * size] for at in range(3))
            for t in range(len(x)):
                weight = np.exp(k @ q[t] / size ** 0.5)
                mixed[t, h * size:(h + 1) * size] = weight @ v / weight.sum()
        x = x + affine(mixed, p + "self_attn.out_proj.weight", p + "self_attn.out_proj.bias")
        inner = np.maximum(affine(normal(x, p + "norm2"), p + "linear1.weight", p + "linear1.bias"), 0)
        x = x + affine(inner, p + "linear2.weight", p + "linear2.bias")
        layer += 1
    out = normal(affine([x.mean(0)], "proj_norm.0.weight", "proj_norm.0.bias"), "proj_norm.1")[0]
    return out / np.linalg.norm(out)


def test_transformer_query_equals_a_plain_forward_pass(spark):
    from ionweave.checks.fixtures import view
    from ionweave.checks.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    got = {}
    for r in QUERIES["transformer_encode"](spark, sf).collect():
        got.setdefault(r["idx"], {})[r["pos"]] = r["value"]
    tokens = {}
    for r in PT.peak_tokens(view(spark, sf, "fx_peaks"), 150).orderBy("idx", "pos").collect():
        tokens.setdefault(r["idx"], []).append((r["norm_mz"], r["norm_int"]))
    cfg = ClusterConfig(embed_dim=32, ff_dim=64)
    assert set(got) == set(tokens) and len(got) > 10
    for idx, pairs in tokens.items():
        want = plain_encoder(np.array(pairs), random_parameters(cfg), cfg.n_heads)
        assert np.abs(np.array([got[idx][p] for p in range(32)]) - want).max() < 1e-4


def test_dealt_tables_keep_tasks_bounded_through_the_peaks_of_a_spectrum(spark):
    from ionweave.operators.peak_tables import bin_spectra
    from ionweave.session import dealt_out

    lines = spark.range(1000).selectExpr("id % 200 AS l", "100.0D + id AS mz", "1.0D + id AS intensity")
    orders = spark.range(200).selectExpr("id AS o")
    keys = {"lines": "l", "orders": "o"}
    small = dealt_out({"lines": lines, "orders": orders}, keys)
    assert small["lines"] is lines and small["orders"] is orders
    dealt = dealt_out({"lines": lines, "orders": orders}, keys, task_rows=20)
    peaks = dealt["lines"].join(dealt["orders"].hint("merge"), F.col("l") == F.col("o")).select(F.col("l").alias("idx"), "mz", "intensity")
    got = bin_spectra(peaks)
    assert got.rdd.getNumPartitions() == 50  # 1000 rows in tasks of 20, whatever spark.sql.shuffle.partitions is
    want = bin_spectra(lines.select(F.col("l").alias("idx"), "mz", "intensity"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_pairs_compared_together_equal_pairs_compared_one_by_one():
    """Lists of many pairs, empty ones and equal places included, are looked up at once as one after the other."""
    import numpy as np

    draw = np.random.default_rng(3)
    a, b = ([np.sort(draw.integers(0, 40, draw.integers(0, 9)) * 0.01) for _ in range(300)] for _ in range(2))
    pair = np.repeat(np.arange(300), [len(x) for x in a])
    got = PT.near_peaks(pair, np.concatenate(a), np.concatenate(b), np.array([len(x) for x in b]), 0.02)
    want = [len(y) > 0 and bool((np.abs(y - p) <= 0.02).any()) for x, y in zip(a, b) for p in x]
    assert got.tolist() == want


def test_peak_maximum_needs_no_second_pass(spark):
    peaks = spark.createDataFrame([(1, 100.0, 4.0), (1, 101.0, 9.0), (1, 102.0, 9.0), (2, 100.0, None), (None, 100.0, 1.0)], "idx long, mz double, intensity double")
    plan = PT.bin_spectra(peaks, 2)._jdf.queryExecution().executedPlan().toString()
    assert len({line.split("Window [", 1)[1] for line in plan.split("\n") if "Window [" in line}) == 1
    top = {(r["idx"], r["mz"]): r["peak_max"] for r in PT._strongest_with_max(peaks, 2).collect()}
    assert top == {(1, 101.0): 9.0, (1, 102.0): 9.0, (2, 100.0): None, (None, 100.0): 1.0}


def test_spectrum_without_places_is_never_confirmed(spark):
    """Spectra whose peaks all lack a place have an empty list; their pairs come back with zero hits."""
    peaks = spark.createDataFrame([(1, 100.0), (1, 200.0), (2, None), (3, 100.01)], "idx long, mz double").withColumn("intensity", F.lit(1.0))
    pairs = spark.createDataFrame([(1, 1, 2, 5.0), (2, 2, 1, 5.0), (3, 1, 3, 0.0), (4, 1, 9, 5.0), (5, 1, 3, None)], "pair_id long, idx_a long, idx_b long, delta double")
    got = {r["pair_id"]: (r["unshifted"], r["shifted"]) for r in PT.fragment_confirmation(pairs, peaks).collect()}
    assert got == {1: (0, 0), 2: (0, 0), 3: (1, 1), 4: (0, 0), 5: (0, 0)}
