import numpy as np
import pytest
from pyspark.sql import functions as F

from ionweave.config import ClusterConfig, PretrainConfig, preprocessing_mismatches
from ionweave.sources import psm as PSM
from ionweave.sources import sinks, store
from ionweave.sources.mgf import expand_paths, read_mgf, training_spectra

ODD = """# a comment
text outside
BEGIN IONS
pepmass=500.25 1234.5
charge=2+
rtinseconds=bad
RT=61.5
100.05 10.0 extra
200.5\t20.5
300.5 x
END IONS

BEGIN IONS
TITLE=empty one
PEPMASS=400
END IONS
BEGIN IONS
TITLE=a=b
PEPMASS=600.5
CHARGE=3-
# inside
150.5 1
  end ions
begin ions
PEPMASS=700
151.5 2
END IONS
"""


def write(path, text):
    path.write_text(text)
    return str(path)


def test_odd_mgf(spark, tmp_path):
    rows = read_mgf(spark, write(tmp_path / "odd.mgf", ODD)).orderBy("idx").collect()
    assert [(r["scan_id"], r["precursor_mz"], r["precursor_charge"], r["rt"]) for r in rows] == [
        ("scan_1", 500.25, 2, 61.5), ("a=b", 600.5, 3, 0.0), ("scan_3", 700.0, 0, 0.0)]
    assert list(rows[0]["mz"]) == [np.float32(100.05), 200.5] and list(rows[0]["intensity"]) == [10.0, 20.5]
    assert {r["source_file"] for r in rows} == {"odd.mgf"}
    named = read_mgf(spark, str(tmp_path / "odd.mgf"), count_empty=True).orderBy("idx").collect()
    assert [r["scan_id"] for r in named] == ["scan_1", "a=b", "scan_4"]


def test_order_limit_quality_and_corrupt(spark, tmp_path):
    def block(i, n, extra=""):
        peaks = "\n".join(f"{100 + 90 * k}.5 {k + 1}" for k in range(n))
        return f"BEGIN IONS\nTITLE=t{i}\nPEPMASS={500 + i}\n{extra}{peaks}\nEND IONS\n"
    write(tmp_path / "b.mgf", "".join(block(i, 6) for i in range(5, 8)) + block(99, 5, "CHARGE=2+ and 3+\n"))
    write(tmp_path / "a.mgf", "".join(block(i, 6 if i else 2) for i in range(5)))
    (tmp_path / "skip.txt").write_text("no")
    assert [p.rsplit("/", 1)[1] for p in expand_paths(spark, str(tmp_path))] == ["a.mgf", "b.mgf"]
    titles = [r["scan_id"] for r in read_mgf(spark, str(tmp_path)).orderBy("idx").collect()]
    assert titles == [f"t{i}" for i in range(8)]
    kept = read_mgf(spark, str(tmp_path), keep_corrupt=True)
    assert [r["scan_id"] for r in kept.filter("corrupt").collect()] == ["t99"]
    first = read_mgf(spark, f"{tmp_path}/b.mgf, {tmp_path}/a.mgf", quality=(5, 250.0), max_spectra=4)
    assert [r["scan_id"] for r in first.orderBy("idx").collect()] == ["t5", "t6", "t7", "t1"]


def test_small_splits_give_the_same_rows(spark, tmp_path):
    text = "".join(f"BEGIN IONS\nPEPMASS={400 + i}\n{100 + i}.25 {i + 1}\n{150 + i}.5 2\nEND IONS\n\n" for i in range(400))
    path = write(tmp_path / "many.mgf", text)
    one = [tuple(r) for r in read_mgf(spark, path).orderBy("idx").select("idx", "scan_id", "precursor_mz").collect()]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    spark.conf.set("spark.sql.files.minPartitionNum", "16")
    try:
        df = read_mgf(spark, path)
        assert df.rdd.getNumPartitions() > 4
        two = [tuple(r) for r in df.orderBy("idx").select("idx", "scan_id", "precursor_mz").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.minPartitionNum")
    assert one == two and one[-1] == (399, "scan_400", 799.0)


def test_training_keys(spark, tmp_path):
    heads = ['SCANS=12|3', 'SCANS=12', 'TITLE=x controllerScans: "45"', 'TITLE=NewScan:7', 'TITLE=88', 'TITLE=none']
    text = "".join(f"BEGIN IONS\n{h}\nPEPMASS={i + 1}\n100.5 1\nEND IONS\n" for i, h in enumerate(heads))
    rows = training_spectra(read_mgf(spark, write(tmp_path / "t.mgf", text))).collect()
    assert {r["scan_id"]: r["precursor_mz"] for r in rows} == {"12": 2.0, "45": 3.0, "7": 4.0, "88": 5.0}


def test_written_blocks_read_back(spark, tmp_path):
    df = spark.createDataFrame([(0, "s0", 500.125, 2, 9.5, [100.5, 200.25], [1.0, 3.5]), (1, "s1", 600.5, 0, 0.0, [50.5], [7.0])],
                               "idx long, scan_id string, precursor_mz double, precursor_charge int, rt double, "
                               "mz array<float>, intensity array<float>")
    sinks.spectrum_blocks(df).orderBy("idx").select("block").coalesce(1).write.text(str(tmp_path / "out"))
    part = next(str(p) for p in (tmp_path / "out").iterdir() if p.name.startswith("part"))
    got = read_mgf(spark, part).orderBy("idx").select(*df.columns).collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in df.collect()]


def test_psm_readers(spark, tmp_path):
    tab = "First Scan\tAnnotated Sequence \tq-Value\tConfidence\tXCorr\n"
    tab += "1\tpepa\t0.001\tHigh\t1.0\n1\tpepb\t0.001\tHigh\t2.0\n2\tpepc\tabc\tHigh\t9\n3\tpepd\t0.5\tHigh\t9\n4\t\t0.0\tHigh\t1\n"
    out = PSM.read_psm(spark, write(tmp_path / "d.txt", tab)).collect()
    assert [tuple(r) for r in out] == [("1", "PEPB")]
    with pytest.raises(ValueError):
        PSM.read_psm(spark, write(tmp_path / "bad.csv", "a,b\n1,2\n"))
    comet = "# version\nscan\tmodified_peptide\te-value\n5\t abc \t0.001\n5\tabc\t0.002\n6\tx\t0.5\n"
    assert [tuple(r) for r in PSM.read_psm(spark, write(tmp_path / "c.txt", comet), "comet").collect()] == [("5", "ABC")]
    generic = "id,seq,fdr\n7,aa,0.01\n7,bb,0.01\n8,cc,0.02\n"
    got = PSM.read_psm(spark, write(tmp_path / "g.csv", generic), "msfragger", scan_col="id", peptide_col="seq", qval_col="fdr")
    assert {tuple(r) for r in got.collect()} == {("7", "AA"), ("7", "BB")}


def test_parameter_files_and_cache(spark, tmp_path):
    from ionweave.operators.encode import checked_parameters, random_parameters
    cfg = ClusterConfig(embed_dim=8, ff_dim=8, n_heads=2, n_layers=1)
    par = random_parameters(cfg)
    path = str(tmp_path / "enc.npz")
    store.write_parameters(path, {**par, "proj_head.0.weight": np.zeros((2, 2))}, epoch=3, val_separation=0.5)
    back = checked_parameters(store.read_parameters(path), cfg)
    assert all(np.array_equal(back[n], par[n]) for n in par)
    meta = store.describe_checkpoint(spark, path).first()
    assert (meta["epoch"], meta["val_separation"]) == (3, 0.5)
    with pytest.raises(ValueError):
        checked_parameters({n: v for n, v in par.items() if n != "input_proj.bias"}, cfg)
    with pytest.raises(ValueError):
        checked_parameters({**par, "other": np.zeros(1)}, cfg)

    a, b = spark.range(5), spark.range(6)
    assert store.fingerprint(a, cfg, "x") == store.fingerprint(a, cfg.replace(output_dir="z"), "x")
    assert len({store.fingerprint(a, cfg, "x"), store.fingerprint(b, cfg, "x"),
                store.fingerprint(a, cfg.replace(seed=1), "x")}) == 3
    calls = []
    def build():
        calls.append(1)
        return a
    for _ in range(2):
        assert store.cached(spark, str(tmp_path / "cache"), "k", build).count() == 5
    assert len(calls) == 1


def test_presets():
    assert ClusterConfig().use_transformer is False and ClusterConfig.command_line().dynamic_merge_enabled
    assert ClusterConfig.seeded().edge_threshold == 0.85
    assert (PretrainConfig().lr, PretrainConfig.sample_run().warmup_epochs) == (5e-5, 3)
    assert preprocessing_mismatches(ClusterConfig(), PretrainConfig()) == ["remove_precursor_peaks"]
    assert ClusterConfig().n_bins == 72_500


def test_command_line_settings():
    from ionweave import __main__ as cli
    args = cli.parser().parse_args(["cluster", "--mgf", "a,b", "--precursor-tol-ppm", "0", "--max-spectra", "7", "--quiet",
                                    "--no-transformer", "--set", "use_hd_prefilter=true", "--set", "hd_n_repeats=4"])
    cfg = cli.cluster_settings(args)
    assert (cfg.mgf_path, cfg.precursor_tol_ppm, cfg.max_spectra, cfg.verbose) == ("a,b", 0.0, 7, False)
    assert cfg.dynamic_merge_enabled and not cfg.use_transformer and cfg.use_hd_prefilter and cfg.hd_n_repeats == 4
    args = cli.parser().parse_args(["cluster", "--no-transformer", "--encoder-weights", "w.npz"])
    assert cli.cluster_settings(args).use_transformer
    with pytest.raises(SystemExit):
        cli.cluster_settings(cli.parser().parse_args(["cluster", "--set", "nothing=1"]))


def test_files_of_one_name_keep_the_order_they_were_given_in(spark, tmp_path):
    from ionweave.sources.mgf import file_ranks, read_mgf

    paths = []
    for folder, title in (("z", "first"), ("a b", "second")):
        (tmp_path / folder).mkdir()
        path = tmp_path / folder / "run.mgf"
        path.write_text(f"BEGIN IONS\nTITLE={title}\nPEPMASS=500\n100 1\n200 2\nEND IONS\n")
        paths.append(str(path))
    assert [r["scan_id"] for r in read_mgf(spark, paths).orderBy("idx").collect()] == ["first", "second"]
    assert file_ranks(["hdfs://n/b/x.mgf", "/a/x.mgf"], ["hdfs://n/a/x.mgf", "hdfs://n/b/x.mgf"]) == {"hdfs://n/a/x.mgf": 1, "hdfs://n/b/x.mgf": 0}


def written_archive(path, state, storages, byteorder=b"little"):
    """A ``.pt`` file by hand: names are written as pickled globals, tensors as calls on storage references."""
    import struct
    import zipfile

    def text(s):
        return b"X" + struct.pack("<I", len(s.encode())) + s.encode()

    def number(i):
        return b"J" + struct.pack("<i", i)

    def tup(*items):
        return b"(" + b"".join(items) + b"t"

    def tensor(kind, key, count, offset, size, stride):
        pid = tup(text("storage"), f"ctorch\n{kind}\n".encode(), text(key), text("cpu"), number(count)) + b"Q"
        hooks = b"ccollections\nOrderedDict\n)R"
        return b"ctorch._utils\n_rebuild_tensor_v2\n" + tup(pid, number(offset), tup(*map(number, size)), tup(*map(number, stride)), b"\x89", hooks) + b"R"

    items = b"".join(text(k) + tensor(*v) for k, v in state.items())
    meta = text("epoch") + number(3) + text("cfg") + b"}" + text("embed_dim") + number(4) + b"s" + text("train_loss") + b"G" + struct.pack(">d", 0.5)
    body = b"\x80\x02}(" + text("model_state_dict") + b"ccollections\nOrderedDict\n)R(" + items + b"u" + meta + b"u."
    with zipfile.ZipFile(path, "w") as out:
        out.writestr("m/data.pkl", body)
        out.writestr("m/byteorder", byteorder)
        for key, data in storages.items():
            out.writestr(f"m/data/{key}", data)


def test_parameter_archive_without_its_library(spark, tmp_path):
    import numpy as np

    from ionweave.sources import store

    values = np.arange(12, dtype="<f4")
    half = (np.array([1.5, -2.0], np.float32).view(np.uint32) >> 16).astype("<u2")
    state = {"w": ("FloatStorage", "0", 12, 2, (2, 3), (5, 1)), "turned": ("FloatStorage", "0", 12, 0, (3, 4), (1, 3)),
             "h": ("BFloat16Storage", "1", 2, 0, (2,), (1,)), "none": ("LongStorage", "2", 0, 0, (0, 3), (3, 1))}
    path = str(tmp_path / "model.pt")
    written_archive(path, state, {"0": values.tobytes(), "1": half.tobytes(), "2": b""})
    got = store.read_parameters(path)
    assert got["w"].tolist() == [[2, 3, 4], [7, 8, 9]]
    assert got["turned"].tolist() == values.reshape(4, 3).T.tolist()
    assert got["h"].tolist() == [1.5, -2.0] and got["none"].shape == (0, 3)
    assert store.training_settings(path) == {"embed_dim": 4}
    row = store.describe_checkpoint(spark, path).first()
    assert (row["epoch"], row["train_loss"], row["n_tensors"], row["n_parameters"]) == (3, 0.5, 4, 20)


def test_parameter_archive_refuses_everything_else(tmp_path):
    import io
    import os
    import pickle
    import zipfile

    from ionweave.sources.archive import ArchiveError, read_archive

    class Call:
        def __reduce__(self):
            return os.getcwd, ()

    def zipped(body):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("m/data.pkl", body)
        return out.getvalue()

    long = tmp_path / "long.pt"
    written_archive(long, {"w": ("FloatStorage", "0", 2, 0, (2, 2), (2, 1))}, {"0": b"\0" * 8})
    negative = tmp_path / "negative.pt"
    written_archive(negative, {"w": ("FloatStorage", "0", 2, 1, (2,), (-1,))}, {"0": b"\0" * 8})
    unknown = tmp_path / "unknown.pt"
    written_archive(unknown, {"w": ("QInt8Storage", "0", 2, 0, (2,), (1,))}, {"0": b"\0" * 8})
    cases = [zipped(pickle.dumps(Call(), 2)), zipped(pickle.dumps(os.getcwd, 4)), zipped(pickle.dumps({1, 2}, 4)), zipped(b"\x80\x02}"),
             zipped(b""), b"no zip file", long.read_bytes(), negative.read_bytes(), unknown.read_bytes()]
    for data in cases:
        with pytest.raises(ArchiveError):
            read_archive(data)
    assert read_archive(zipped(pickle.dumps({"a": [1, 2.5, None, True, "x"]}, 2))) == {"a": [1, 2.5, None, True, "x"]}
