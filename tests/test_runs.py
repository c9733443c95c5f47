import numpy as np
import pytest
from pyspark.sql import functions as F

from ionweave.config import ClusterConfig, PretrainConfig
from ionweave.operators import classes as C
from ionweave.operators import contrastive as L
from ionweave.operators.rerank import rerank, run_summary
from ionweave.plans import cluster as plan
from ionweave.plans import pretrain
from ionweave.streaming.ingest import start_ingest

PROTON = 1.007276


def mgf(rows):
    return "".join(
        f"BEGIN IONS\nTITLE={t}\nPEPMASS={m:.6f}\nCHARGE={z}+\nRTINSECONDS={10 + i}\n"
        + "".join(f"{a:.4f} {b}\n" for a, b in peaks) + "END IONS\n\n" for i, (t, m, z, peaks) in enumerate(rows))


def peptide(seed, shift=0.0, at=()):
    rng = np.random.default_rng(seed)
    mz = np.sort(rng.uniform(120, 1300, 12))
    return [(m + (shift if i in at else 0.0), 100 + 10 * i) for i, m in enumerate(mz)]


@pytest.fixture()
def files(tmp_path):
    near = lambda m, k: m + k * 0.0005
    one = [(f"a{k}", near(600, k), 2, peptide(1)) for k in range(3)] + [(f"b{k}", near(700, k), 2, peptide(2)) for k in range(3)]
    two = [(f"a{k}", near(600, k), 2, peptide(1)) for k in range(3, 5)] + [("lone", 810.0, 2, peptide(9))]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.mgf").write_text(mgf(one))
    (tmp_path / "in" / "two.mgf").write_text(mgf(two))
    return tmp_path


@pytest.mark.parametrize("changes", [{"n_eigenvectors": 1}, {"method": "components"}, {"use_hdbscan": True, "strict_reference": False},
                                     {"use_hd_prefilter": True, "n_eigenvectors": 1}, {"method": "bucketed"},
                                     {"use_hd_prefilter": True, "use_encoder": False, "method": "components"}])
def test_clusters_of_two_files(spark, files, changes):
    cfg = ClusterConfig(mgf_path=str(files / "in"), embed_dim=32, precursor_tol_ppm=20.0, verbose=False, **changes)
    result, labels, spectra = plan.cluster(spark, cfg)
    rows = labels.join(spectra.select("idx", "scan_id"), "idx").collect()
    label = {r["scan_id"]: r["label"] for r in rows}
    assert len({label[f"a{k}"] for k in range(5)}) == 1 and len({label[f"b{k}"] for k in range(3)}) == 1
    assert label["a0"] != label["b0"] and min(label["a0"], label["b0"]) == 0 and label["lone"] == -1
    clusters = {r["n_members"]: r for r in result.clusters.collect()}
    assert set(clusters) == {3, 5} and clusters[5]["n_source_files"] == 2 and clusters[5]["confidence"] == "HIGH"


def test_nothing_similar_is_all_noise(spark, files):
    cfg = ClusterConfig(mgf_path=str(files / "in"), output_dir=str(files / "none"), embed_dim=16, edge_threshold=1.5, verbose=False)
    result = plan.run(spark, cfg)
    assert result.clusters.count() == 0 and result.consensus.count() == 0
    assert spark.read.option("header", True).option("sep", "\t").csv(f"{cfg.output_dir}/noise_spectra.tsv").count() == 9
    with pytest.raises(ValueError):
        (files / "empty").mkdir()
        (files / "empty" / "x.mgf").write_text("nothing here\n")
        plan.run(spark, cfg.replace(mgf_path=str(files / "empty")))


def test_all_result_files(spark, files):
    out = str(files / "out")
    cfg = ClusterConfig(mgf_path=str(files / "in"), output_dir=out, embed_dim=32, precursor_tol_ppm=20.0, verbose=False, resume=True,
                        n_eigenvectors=1)
    plan.run(spark, cfg)
    got = spark.read.option("header", True).option("sep", "\t").csv(f"{out}/clusters.tsv")
    assert got.count() == 8 and {r["ptm_flag"] for r in got.collect()} == {"False"}
    assert got.first()["quality_score"].startswith(("1.0", "0.9"))
    noise = spark.read.option("header", True).option("sep", "\t").csv(f"{out}/noise_spectra.tsv").collect()
    assert [tuple(r) for r in noise] == [("lone", "two.mgf", "810.0000", "2")]
    from ionweave.sources.mgf import read_mgf
    back = read_mgf(spark, [str(p) for p in sorted((files / "out" / "consensus_spectra.mgf").iterdir()) if p.name.startswith("part")])
    assert back.count() == 2 and all(r["title"].startswith("cluster_") for r in back.collect())
    summary = (files / "out" / "summary.txt").read_text()
    assert "clustering" in (files / "out" / "run.log").read_text()
    assert "Input spectra" in summary and "9" in summary and "edge_threshold" in (files / "out" / "config.txt").read_text()
    plan.run(spark, cfg)  # resumes from the cached stages
    assert len([p for p in (files / "out" / "checkpoints").iterdir() if not p.name.startswith(".")]) == 2


def test_modified_pairs_and_strangers(spark):
    base, ox = 1000.0, 15.9949
    masses = [base, base + ox, base + 2 * ox, base + 500]
    plain = [(200.0 + 50 * i, 10.0) for i in range(6)]
    def moved(n):
        return [(m + n * ox if i >= 4 else m, v) for i, (m, v) in enumerate(plain)]
    peaks_of = [plain, moved(1), moved(2), [(777.7, 5.0)]]
    rows, peaks = [], []
    for g, (m, ps) in enumerate(zip(masses, peaks_of)):
        rows.append((g, 0, m + PROTON, 1, 5.0, "f.mgf"))
        peaks += [(g, a, b) for a, b in ps]
    # a second label whose groups are unrelated
    for g, m in ((10, 900.0), (11, 903.3)):
        rows.append((g, 1, m + PROTON, 1, 0.0, "g.mgf"))
        peaks.append((g, 300.0 + g, 1.0))
    spectra = spark.createDataFrame(rows, "idx long, label long, precursor_mz double, precursor_charge int, rt double, source_file string")
    vectors = spectra.select("idx", F.array(F.lit(1.0), F.lit(0.0)).alias("embedding"))
    result = rerank(spectra.select("idx", "label"), spectra, vectors, spark.createDataFrame(peaks, "idx long, mz double, intensity double"))
    got = [(r["cluster_id"], r["parent_cluster_id"], r["ptm_flag"], r["ptm_delta_label"], r["heterogeneous_flag"], r["confidence"])
           for r in result.clusters.orderBy("pos").collect()]
    assert got == [(2, 0, True, "Oxidation", False, "HIGH"), (3, 0, True, "Oxidation", False, "HIGH"),
                   (4, 0, True, "Oxidation", False, "HIGH"), (5, 0, False, "", False, "HIGH"),
                   (6, 1, False, "", True, "HIGH"), (7, 1, False, "", True, "HIGH")]
    counts = run_summary(result.clusters, spectra.select("idx", "label")).first()
    assert (counts["n_clusters"], counts["n_ptm"], counts["n_heterogeneous"], counts["n_split"]) == (6, 0, 2, 6)


def test_streamed_files_are_encoded_once(spark, files):
    cfg = ClusterConfig(embed_dim=16)
    args = (spark, str(files / "in"), str(files / "table"), str(files / "state"), cfg)
    start_ingest(*args).awaitTermination()
    assert spark.read.parquet(str(files / "table")).count() == 9
    (files / "in" / "three.mgf").write_text(mgf([("late", 500.0, 2, peptide(5))]))
    start_ingest(*args).awaitTermination()
    table = spark.read.parquet(str(files / "table"))
    assert table.count() == 10 and table.select("idx").distinct().count() == 10
    numbers = {b: sorted(r["idx"] - (b << 33) for r in table.filter(f"batch = {b}").collect()) for b in (0, 1)}
    assert numbers == {0: list(range(9)), 1: [0]}


def test_positions_are_dense_over_many_partitions(spark):
    from ionweave.session import checkpoint, dense_positions

    out = dense_positions(checkpoint(spark.range(500).repartition(37).filter("id % 7 <> 0")), "n").select("n").collect()
    assert sorted(r["n"] for r in out) == list(range(len(out)))


# --- training ----------------------------------------------------------------------


def test_loss_equals_plain_formula():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(8, 4))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([0, 0, 1, 1, 2, 2, 3, 4])
    supcon, spread, usable = L.contrastive_loss(x, label, 0.1)
    sim, terms = x @ x.T, []
    for i in range(8):
        pos = [j for j in range(8) if j != i and label[j] == label[i]]
        if pos:
            total = np.log(sum(np.exp(sim[i, j] / 0.1) for j in range(8) if j != i))
            terms.append(-np.mean([sim[i, j] / 0.1 - total for j in pos]))
    neg = [np.exp(-2 * (2 - 2 * sim[i, j])) for i in range(8) for j in range(8) if label[i] != label[j]]
    assert usable and abs(supcon - np.mean(terms)) < 1e-12 and abs(spread - np.log(np.mean(neg) + 1e-8)) < 1e-12
    assert L.contrastive_loss(x[:3], np.arange(3), 0.1) == (0.0, 0.0, False)


def test_batches_have_distinct_classes_and_samples(spark):
    rows = [(c, c * 1000 + i) for c, n in enumerate([3, 5, 40, 8, 8, 9]) for i in range(n)]
    df = spark.createDataFrame(rows, "label_idx long, sample long")
    out = C.pk_batches(df, 4, 5, seed=1).toPandas()
    assert out.batch.nunique() == len(rows) // 20
    for _, part in out.groupby("batch"):
        assert len(part) == 20 and part.label_idx.nunique() == 4
        for c, draws in part.groupby("label_idx"):
            if c != 0:
                assert draws["sample"].nunique() == 5
    other = C.pk_batches(df, 4, 5, seed=1, epoch=1).toPandas()
    sets = lambda x: {tuple(sorted(g.label_idx.unique())) for _, g in x.groupby("batch")}
    assert sets(out) != sets(other) or not out.equals(other)
    again = C.pk_batches(df.repartition(3), 4, 5, seed=1).toPandas()
    key = ["batch", "slot", "draw"]
    assert out.sort_values(key).reset_index(drop=True).equals(again.sort_values(key).reset_index(drop=True))


def test_augmentation_is_seeded_and_bounded(spark):
    df = spark.createDataFrame([(i, [100.0 + 10 * k for k in range(50)], [1.0 + k for k in range(50)]) for i in range(40)],
                               "idx long, mz array<double>, intensity array<double>")
    from ionweave.functions.peaks import zipped
    make = lambda d: {r["idx"]: r["a"] for r in d.select("idx", L.augmented(zipped(), F.col("idx")).alias("a")).collect()}
    one, two = make(df), make(df.repartition(5))
    assert one == two
    sizes = [len(v) for v in one.values()]
    assert 0.8 < np.mean(sizes) / 50 < 0.9
    assert all(50 <= p["mz"] <= 1500 and p["intensity"] >= 0 for v in one.values() for p in v)
    single = df.limit(1).select(L.augmented(zipped(), F.col("idx"), drop=1.0).alias("a")).first()["a"]
    assert len(single) == 50


def test_long_table_augments_as_arrays_do_and_names_its_parts_once(spark):
    from pyspark.sql import functions as F
    from ionweave.operators.contrastive import augmented, augmented_peaks

    rows = [(k, i, 100.0 + 7.5 * i, float((i * 37 + k) % 90)) for k in range(60) for i in range(1 + k % 9)]
    long = spark.createDataFrame(rows, "idx long, i int, mz double, intensity double")
    arrays = long.groupBy("idx").agg(F.sort_array(F.collect_list(F.struct("i", "mz", "intensity"))).alias("a"))
    arrays = arrays.select("idx", F.transform("a", lambda p: F.struct(p["mz"].alias("mz"), p["intensity"].alias("intensity"))).alias("a"))
    column = augmented(F.col("a"), F.col("idx"), drop=0.6)
    one = arrays.select("idx", F.posexplode(column).alias("pos", "p")).select("idx", "pos", "p.mz", "p.intensity")
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, augmented_peaks(long, drop=0.6).collect()))
    # the draws of a peak occur once each: one that decides on it, two for the intensity and two for the m/z
    assert str(column).count("2.147483647E9") == 5


def test_training_data_and_batches(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows, hits = [], []
    for c in range(8):
        base = np.sort(rng.uniform(100, 1400, 12))
        for k in range(5):
            i = len(rows)
            rows.append((i, str(i), 500.0 + c, 2, [float(v) for v in base + rng.normal(size=12) * 0.01],
                         [float(v) for v in rng.uniform(50, 100, 12)]))
            hits.append((str(i), f"PEP{c}"))
    spectra = spark.createDataFrame(rows, "idx long, scan_id string, precursor_mz double, precursor_charge int, mz array<float>, intensity array<float>")
    psm = spark.createDataFrame(hits, "scan_id string, peptide string")
    cfg = PretrainConfig(embed_dim=16, ff_dim=16, n_heads=2, n_layers=1, epochs=3, lr=3e-3, warmup_epochs=1, val_split=0.4,
                         pk_classes_per_batch=4, pk_samples_per_class=3, augment=False, output_path=str(tmp_path / "batches"))
    data = pretrain.prepare(spectra, psm, cfg)
    sides = [{r["label"].rsplit("|z", 1)[0] for r in part.collect()} for part in (data.train, data.validation)]
    assert not sides[0] & sides[1] and len(sides[0] | sides[1]) == 8
    paths = pretrain.write_batches(data, cfg, 2)
    one, two = (spark.read.parquet(p) for p in paths)
    assert one.count() == two.count() > 0 and one.first()["learning_rate"] > 0
    assert set(map(str, one.select("batch", "slot", "label_idx").collect())) != set(map(str, two.select("batch", "slot", "label_idx").collect()))
    from ionweave.operators.encode import random_parameters
    from ionweave.sources.store import describe_checkpoint, write_parameters
    weights = random_parameters(cfg)
    assert set(pretrain.validate(data.validation, cfg, weights)) == {"intra", "inter", "separation"}
    best = {"epoch": 2, "train_loss": 0.5, "loss": 0.5, "val_intra_sim": 0.9, "val_inter_sim": 0.1, "val_separation": 0.8}
    from dataclasses import asdict
    weights_path = str(tmp_path / "enc.npz")
    write_parameters(weights_path, weights, cfg=asdict(cfg), **best)
    assert describe_checkpoint(spark, weights_path).first()["epoch"] == 2
    p = pretrain.Patience(2)
    assert [p.better(i, v) for i, v in enumerate([1.0, 0.5, 2.0, 1.0, 1.0])] == [True, False, True, False, False] and p.exhausted
    from ionweave.plans.cluster import encode
    from ionweave.config import ClusterConfig as CC
    assert encode(spectra, CC(embed_dim=16, ff_dim=16, n_heads=2, n_layers=1, encoder_weights=weights_path)).count() == 40
