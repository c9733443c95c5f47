"""The pipeline's stages against brute-force versions of their decisions."""

import zlib

import brute
import pytest

import corpus_pipeline as P
from ionweave.llm.common import documents

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    """Rows before and after every stage, as {name: ({id: text}, [rows])}."""
    from ionweave.llm.common import stored

    docs, out = documents(spark, SF), {}
    for name, stage in P.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = stored(stage(spark, docs, SF), name)
        out[name] = (before, docs.collect())
        assert name == P.STAGES[-1][0] or docs.columns == documents(spark, SF).columns
    return out


def shingles(text, n=5):
    w = brute.TOKENS.findall(brute.lower(text))
    return {" ".join(w[i:i + n]) for i in range(max(1, len(w) - n + 1))}


def test_order_of_stages():
    assert [n for n, _ in P.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "decontamination", "source_mixing"]


def test_toxic_documents_go(spark, stages):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before, after = stages["toxicity"]
    kept = {r["doc_id"] for r in after}
    held = [d for d in labels if d in before and zlib.crc32(str(d).encode()) % 5 == 0]
    toxic, clean = [d for d in held if labels[d]], [d for d in held if not labels[d]]
    # Two of the six held-out toxic texts of this small table have no word that a toxic training text favours.
    assert sum(d not in kept for d in toxic) >= 0.6 * len(toxic)
    assert sum(d in kept for d in clean) >= 0.98 * len(clean)
    assert all(r["text"] == before[r["doc_id"]] for r in after)


def test_shared_lines_go(stages):
    before, after = stages["line_dedup"]
    strip = " \t\n\x0b\x0c\r"
    holders = {}
    for d, t in before.items():
        for line in (t or "").split("\n"):
            key = brute.lower(line.strip(strip))
            if len(key) >= 20:
                holders.setdefault(key, set()).add(d)
    want = {d: "\n".join(x for x in (t or "").split("\n") if len(h := holders.get(brute.lower(x.strip(strip)), ())) < 3 or max(h) == d) for d, t in before.items()}
    assert {r["doc_id"]: r["text"] for r in after} == want


def test_near_copies_go(stages):
    before, after = stages["simhash_near_dedup"]
    kept = {r["doc_id"] for r in after}
    sets = {d: shingles(t) for d, t in before.items()}
    ids, alike, partners = sorted(sets), [], {}
    index = {}
    for d in ids:
        for s in sets[d]:
            index.setdefault(s, []).append(d)
    seen = {(a, b) for g in index.values() if len(g) > 1 for i, a in enumerate(g) for b in g[i + 1:]}
    for a, b in seen:
        j = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
        if j >= 0.8:
            alike.append((a, b))
        if j >= 0.5:
            partners.setdefault(b, set()).add(a)
            partners.setdefault(a, set()).add(b)
    assert len(alike) > 5
    assert sum(a in kept and b in kept for a, b in alike) <= 0.1 * len(alike)
    gone = set(ids) - kept
    assert all(d in partners for d in gone)  # nothing goes without a similar document
    assert all(r["text"] == before[r["doc_id"]] for r in after)


def test_benchmark_passages_go(spark, stages):
    items = [brute.WORDS.findall(brute.lower(r["text"])) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before, after = stages["decontamination"]
    kept = {r["doc_id"] for r in after}
    for d, t in before.items():
        words = brute.WORDS.findall(brute.lower(t))
        known = set(words)
        near = [i for i in items if 2 * sum(w in known for w in i) >= len(i)]  # half of an item's words have to be there for a score of a half
        hit = any(brute.smith_waterman(i, words) >= len(i) for i in near)
        assert (d not in kept) == hit


def test_sources_are_mixed(stages):
    before, after = stages["source_mixing"]
    assert {r["doc_id"] for r in after} <= before.keys()
    assert 0.8 * len(before) < len(after) < 1.25 * len(before)
    copies = {}
    for r in after:
        copies.setdefault(r["doc_id"], []).append(r["copy"])
    assert all(sorted(c) == list(range(1, len(c) + 1)) for c in copies.values())


def test_run_gives_the_last_stage(spark, stages):
    got = sorted((r["doc_id"], r["copy"]) for r in P.run(spark, SF).collect())
    assert got == sorted((r["doc_id"], r["copy"]) for r in stages["source_mixing"][1])


def test_stages_keep_further_columns_and_take_odd_rows(spark):
    from brute import ODD_TEXTS

    names = "doc_id long, text string, lang string, source string, n_chars long, score string, n_lines string, copy string, _gone int"
    rows = [(i if i != 3 else None, t, None, "s" if i % 2 else None, None, "own", "own", "own", i) for i, t in enumerate([*ODD_TEXTS, ODD_TEXTS[-1]])]
    docs = spark.createDataFrame(rows, names)
    for frame in (docs, docs.limit(0)):
        for name, stage in P.STAGES[:-1]:
            out = stage(spark, frame, SF)
            assert out.columns == docs.columns
            kept = out.collect()
            assert all((r["score"], r["n_lines"], r["copy"]) == ("own", "own", "own") for r in kept)
            assert len(kept) == 0 or frame is docs
        assert P.STAGES[-1][1](spark, frame, SF).columns == [c for c in docs.columns if c != "copy"] + ["copy"]


def test_texts_travel_in_small_batches(spark):
    """A batch for Python is bounded in bytes, however many rows a task has; the session's own limit wins."""
    import pyarrow as pa

    from ionweave.llm.common import TEXT_BYTES, small_batches

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)
    P.toxicity_filter(spark, documents(spark, SF), SF)
    assert int(spark.conf.get(key).rstrip("b")) == TEXT_BYTES

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    rows = spark.range(0, 3000, 1, 1).selectExpr("id", "repeat('x', 10000) AS text")
    got = [r["n"] for r in rows.mapInArrow(sizes, "n long").collect()]
    assert sum(got) > 30_000_000 and max(got) <= 1.1 * TEXT_BYTES
    spark.conf.set(key, 1 << 20)
    small_batches(spark)
    assert int(spark.conf.get(key).rstrip("b")) == 1 << 20
    spark.conf.unset(key)
