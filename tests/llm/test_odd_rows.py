"""Missing values, empty and long texts, ties, repeated rows, empty tables and clashing columns; and brute-force checks."""

import hashlib
import random
import re
import zlib

import brute
import pytest
from brute import ODD_TEXTS
from pyspark.sql import functions as F

from ionweave.llm import decontaminate, exact_dedup, line_dedup, mixing, token_counts, toxicity
from ionweave.llm.common import documents

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, copy string, score string, n_lines string, _gone string"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, None, s, None, "c", "s", "l", "k") for d, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "src0" if i % 3 else None) for i, t in enumerate(ODD_TEXTS)]
    rows += [(None, "text without id", "src1"), (2, " ", "src1"), (2, " ", "src1"), (5, "another text of id 5", None)]
    return frame(spark, rows), rows


# --- toxicity -----------------------------------------------------------------------


def test_folding_and_exceptions():
    assert toxicity.fold("Ѕtup1d, TR4SH!!") == " stupid trashii "
    matcher = toxicity.Matcher({" trash ": 3.0, " lowei": 2.0, " low": 1.0}, ("trash can",))
    weight = lambda t: matcher.weight(toxicity.fold(t))
    assert weight("such trash") == 3.0
    assert weight("the trash can here") == 0.0
    assert weight("trash, trash can") == 3.0
    assert weight("loweischaft below lower") == 3.0
    assert weight("") == 0.0


def test_toxicity_learns_on_its_share_only(spark):
    docs, labels = documents(spark, SF), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit(docs, labels)
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.fit(docs, flipped) == model
    rows = toxicity.predictions(docs, model).collect()
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.9 * len(held)


def test_toxicity_odd_rows(spark, odd):
    docs, rows = odd
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, none)
    out = toxicity.score(docs, model)
    assert out.columns == [c for c in docs.columns if c != "score"] + ["score"]
    assert out.count() == len(rows)
    assert toxicity.predictions(docs, model).filter("predicted = 1").count() == 0
    assert toxicity.predictions(docs.limit(0), model).count() == 0


# --- mixing -------------------------------------------------------------------------


def test_mixing_reaches_its_weights(spark):
    rows = [(i, "x" * (1 + i % 7), "big" if i % 3 else "small") for i in range(6000)]
    docs = frame(spark, rows)
    rates = mixing.source_rates(docs, weights={"big": 1.0, "small": 3.0})
    out = mixing.replicate(docs, rates, seed=5).groupBy("source").agg(F.sum(F.length("text")).alias("c")).collect()
    share = {r["source"]: r["c"] for r in out}
    assert share["small"] / (share["big"] + share["small"]) == pytest.approx(0.75, abs=0.02)
    counts = {r["doc_id"]: r["n"] for r in mixing.replicate(docs, rates, seed=5).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    rate = {r["source"]: r["rate"] for r in rates.collect()}
    for d, _, s in rows[:500]:
        u = int(hashlib.md5(f"5|{d}".encode()).hexdigest()[:13], 16) / 16**13
        import math

        p, k, total = math.exp(-rate[s]), 0, math.exp(-rate[s])
        while total <= u:
            k += 1
            p *= rate[s] / k
            total += p
        assert counts.get(d, 0) == k


@pytest.mark.parametrize("limit", [0, 10_000])
def test_mixing_odd_rows(spark, odd, monkeypatch, limit):
    docs, rows = odd
    monkeypatch.setattr(mixing, "ROWS_TO_BROADCAST", limit)
    out = mixing.replicate(docs, mixing.source_rates(docs, epochs=3.0))
    assert out.columns == [c for c in docs.columns if c != "copy"] + ["copy"]
    got = out.collect()
    assert len(got) > len(rows)
    two = [r["copy"] for r in got if r["doc_id"] == 2 and r["source"] == "src1"]
    assert sorted(two) == sorted([*range(1, len(two) // 2 + 1)] * 2)  # both rows of the id in this source are repeated alike
    assert mixing.replicate(docs.limit(0), mixing.source_rates(docs.limit(0))).count() == 0


# --- exact dedup --------------------------------------------------------------------


def dedup_want(rows):
    def norm(t):
        return re.sub(r"[\x20\x09-\x0D]", "", t or "")

    groups = {}
    for at, (d, t) in enumerate(rows):
        groups.setdefault(norm(t), []).append((-len(t or ""), d is None, d or 0, at))
    best = {n: min(g) for n, g in groups.items()}
    out = [(d, rows[best[norm(t)][3]][0], len(groups[norm(t)]), at == best[norm(t)][3], hashlib.sha256(norm(t).encode()).hexdigest())
           for at, (d, t) in enumerate(rows)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_hash", [F.xxhash64, lambda c: F.length(c).cast("bigint") % 3])
@pytest.mark.parametrize("chars", [3, 4096])
def test_exact_dedup_odd_rows_and_hash_clashes(spark, odd, block_hash, chars):
    docs, rows = odd
    long = ["ab" * 40, "ab" * 39 + "ba", "a b" * 27, "ab" * 40 + "  ", "abc" * 3000, "abc" * 3000 + "\n"]
    rows = [(d, t) for d, t, _ in rows] + [(100 + i, t) for i, t in enumerate(long)] + [(100, long[0]), (102, long[2])]
    rows += [(1, "a b"), (1, "a b"), (2, "ab"), (None, None), (None, "z z"), (None, "z z"), (7, "q"), (7, "q "), (7, "q ")]
    docs = frame(spark, [(d, t, "s") for d, t in rows])
    got = sorted((tuple(r) for r in exact_dedup.duplicate_groups(docs, chars, block_hash).collect()), key=repr)
    assert got == dedup_want(rows)
    assert sum(r[3] for r in got) == len({r[4] for r in got})
    assert exact_dedup.duplicate_groups(docs.limit(0)).count() == 0


# --- line dedup ---------------------------------------------------------------------


def test_line_dedup_odd_rows(spark, odd):
    docs, rows = odd
    out = line_dedup.drop_shared_lines(docs)
    assert set(out.columns) == set(docs.columns) | {"n_dropped"}
    strip = " \t\n\x0b\x0c\r"
    holders = {}
    for d, t, _ in rows:
        for line in (t or "").split("\n"):
            key = brute.lower(line.strip(strip))
            if len(key) >= 20:
                holders.setdefault(key, set()).add(-1 if d is None else d)
    want = []
    for d, t, _ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(h := holders.get(brute.lower(x.strip(strip)), ())) < 3 or max(h) == d]
        want.append((d, "\n".join(kept), len(lines), len(lines) - len(kept)))
    assert sorted((tuple(r) for r in out.select("doc_id", "text", "n_lines", "n_dropped").collect()), key=repr) == sorted(want, key=repr)
    assert sum(w[3] for w in want) > 2
    assert line_dedup.drop_shared_lines(docs.limit(0)).count() == 0


# --- token counts -------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_counts.tokenizer_path())
    return lambda text: len(t.encode(text, add_special_tokens=False).ids)


def test_token_counts_match_the_library(spark, odd, library):
    docs = documents(spark, SF).select("doc_id", "text").limit(200)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in token_counts.token_totals(documents(spark, SF), token_counts.tokenizer_path()).collect():
        if r["doc_id"] in texts:
            n = library(texts[r["doc_id"]])
            assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(texts[r["doc_id"]].encode()), n, n > 1024)
    odd_docs, rows = odd
    got = sorted((r["n_bytes"], r["n_tokens"]) for r in token_counts.token_totals(odd_docs, token_counts.tokenizer_path()).collect())
    assert got == sorted((len((t or "").encode()), library(t or "")) for _, t, _ in rows)
    assert token_counts.token_totals(odd_docs.limit(0), token_counts.tokenizer_path()).count() == 0


def test_every_prefix_is_exact(spark, odd, library):
    c = token_counts.PrefixCounter(token_counts.tokenizer_path())
    r = random.Random(4)
    texts = ["a  b  c\n\n d's it'll <|endoftext|>x  ", "héllo wörld  \t 123 foo…", "日本語 テスト  ok", "aaaaaaaaaaaaaaaaaaaaaa", "   ", "<|endoftext|>"]
    texts += ["".join(r.choice(" \n'tsaéñ1.<|") for _ in range(30)) for _ in range(20)]
    for text in texts:
        index = c.index(text)
        counts = [library(text[:k]) for k in range(len(text) + 1)]
        assert [c.tokens_at(text, index, k) for k in range(len(text) + 1)] == counts
        for budget in (0, 1, 3, 8, 1000):
            k = c.longest_prefix(text, index, budget)
            assert counts[k] <= budget
    rows = {r["doc_id"]: r for r in token_counts.prefix_index(documents(spark, SF).limit(20), token_counts.tokenizer_path()).collect()}
    assert all(r["n_tokens"] == r["piece_counts"][-1] and len(r["piece_counts"]) == len(r["piece_ends"]) for r in rows.values())


# --- decontamination ----------------------------------------------------------------


def test_smith_waterman_matches_plain_version():
    import numpy as np

    r = random.Random(1)
    pairs = [([r.randrange(5) for _ in range(r.randrange(1, 20))], [r.randrange(5) for _ in range(r.randrange(0, 30))]) for _ in range(60)]
    got = decontaminate.smith_waterman([(np.array(a, np.int32), np.array(b, np.int32)) for a, b in pairs])
    assert got.tolist() == [brute.smith_waterman(a, b) for a, b in pairs]


def test_passages_are_cut_and_aligned_by_one_worker(spark):
    docs = frame(spark, [(1, "one two three four five", "s"), (2, "six", "s")])
    bench = spark.createDataFrame([(7, "two three four five")], "item_id long, text string")
    found = decontaminate.contaminated(docs, bench)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert [tuple(r)[:3] for r in found.collect()] == [(1, 7, 1.0)]


def test_edited_passages_are_found_in_common_and_rare_places(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghijklm") for _ in range(5))
    items = [[word() for _ in range(r.randrange(20, 60))] for _ in range(20)]
    texts, want = [], set()
    for d in range(300):
        words = [word() for _ in range(r.randrange(20, 200))]
        if d % 3 == 0:  # half of one item leaks into a third of all documents
            words[5:5] = items[0][: len(items[0]) * 3 // 4]
            want.add((d, 0))
        elif d % 10 == 1:
            k = r.randrange(1, 20)
            copy = list(items[k])
            for at in r.sample(range(len(copy)), len(copy) // 8):
                copy[at] = word()
            words[7:7] = copy
            want.add((d, k))
        texts.append((d, ", ".join(words).upper(), "s"))
    bench = spark.createDataFrame([(k, " ".join(i), 1.0) for k, i in enumerate(items)] + [(None, "x y z", 0.0), (99, None, 0.0), (98, "two words", 0.0)], "item_id long, text string, score double")
    docs = frame(spark, [*texts, (None, None, None), (1000, "", "s"), (0, texts[0][1], "s")])
    found = decontaminate.contaminated(docs, bench)
    assert {(x["doc_id"], x["item_id"]) for x in found.collect()} == want
    left = decontaminate.without_contaminated(docs, found)
    assert left.columns == docs.columns
    assert left.count() == docs.count() - len({d for d, _ in want}) - 1
    assert decontaminate.contaminated(docs.limit(0), bench).count() == 0
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0


def plain_contaminated(texts, items, threshold=0.5):
    """Full alignment of every text with every item, no seeds; items of one or two words as a whole."""
    out = set()
    for d, text in texts:
        words = brute.WORDS.findall(brute.lower(text))
        for k, item in items.items():
            if item and brute.smith_waterman(item, words) >= 2 * len(item) * (threshold if len(item) > 2 else 1):
                out.add((d, k))
    return out


@pytest.mark.parametrize("letters", [3, 12])
@pytest.mark.parametrize("threshold", [0.5, 0.7])
def test_every_alignment_above_the_threshold_is_found(spark, monkeypatch, letters, threshold):
    """Words changed, left out and added anywhere, few and many different words, texts cut into parts."""
    monkeypatch.setattr(decontaminate, "WORDS_AT_ONCE", 150)
    r = random.Random(letters)
    vocabulary = ["".join(r.choice("abcdefghijkl"[:letters]) for _ in range(4)) for _ in range(40 if letters == 3 else 2000)]
    items = {k: [r.choice(vocabulary) for _ in range(n)] for k, n in enumerate([1, 2, 2, 3, 4, 7, 12, 19, 19, 30, 45])}
    texts = []
    for d in range(150):
        words = [r.choice(vocabulary) for _ in range(r.randrange(0, 700 if d % 20 == 0 else 60))]
        for k in r.sample(sorted(items), d % 3):
            copy = list(items[k])
            if d % 2:
                copy[2::3] = [r.choice(vocabulary) for _ in copy[2::3]]
            else:
                copy = [w for w in copy if r.random() > 0.25]
                for _ in range(len(copy) // 5):
                    copy.insert(r.randrange(len(copy)), r.choice(vocabulary))
            at = r.randrange(len(words) + 1)
            words[at:at] = copy
        texts.append((d, " ".join(words)))
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string")
    found = decontaminate.contaminated(frame(spark, [(d, t, "s") for d, t in texts]), bench, threshold).collect()
    want = plain_contaminated(texts, items, threshold)
    assert {(x["doc_id"], x["item_id"]) for x in found} == want
    assert len(found) == len(want) > 30
    long_only = decontaminate.contaminated(frame(spark, [(d, t, "s") for d, t in texts]), bench, threshold, least_words=3)
    assert {(x["doc_id"], x["item_id"]) for x in long_only.collect()} == {(d, k) for d, k in want if len(items[k]) > 2}


def test_short_items_and_changed_thirds(spark):
    item = [f"w{i}" for i in range(19)]
    copy = [w if i % 3 else f"x{i}" for i, w in enumerate(item)]
    copy[0] = item[0]
    bench = spark.createDataFrame([(1, "what now"), (2, " ".join(item)), (3, "!!")], "item_id long, text string")
    texts = [(1, "x what now y", "s"), (2, "what then now", "s"), (3, "so " + " ".join(copy) + " end", "s"), (3, "so " + " ".join(copy) + " end", "s"), (4, " ".join([*item, *item]), "s")]
    found = {(x["doc_id"], x["item_id"]): (x["score"], x["start"]) for x in decontaminate.contaminated(frame(spark, texts), bench).collect()}
    assert found.keys() == {(1, 1), (3, 2), (4, 2)}
    assert found[1, 1][0] == found[4, 2][0] == 1 and found[4, 2][1] == 0


def test_exact_dedup_rows_equal_the_sql(spark, tmp_path, monkeypatch):
    """Repeated rows, missing ids and texts, in the query and its SQL alike; a run of copies may end anywhere."""
    import duckdb
    from oracle_check import rows

    from ionweave.llm.oracle import ORACLE
    from ionweave.llm.queries import QUERIES

    monkeypatch.setattr(exact_dedup, "COPY_RUN", 4)
    docs = [(1, "a b"), (1, "a b"), (2, "ab"), (None, None), (3, ""), (None, "zz"), (None, "z z"), *[(9, "many copies")] * 13, (8, "manycopies")]
    frame(spark, [(d, t, "s") for d, t in docs]).write.parquet(str(tmp_path / "documents.parquet"))
    df = QUERIES["op4_exact_dedup"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    res = con.execute(ORACLE["op4_exact_dedup"])
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows([c[0] for c in res.description], res.fetchall())
