"""License scan and secret scan against plain versions."""

import random
import re
import string

import brute
import pytest
from brute import ODD_TEXTS

from ionweave.llm import license_scan, secrets
from ionweave.llm.common import documents

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark, SF)


def odd(spark, texts=ODD_TEXTS):
    return spark.createDataFrame([(i if i != 3 else None, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, n_words string, spans int")


def license_rows(found):
    return sorted(((r["doc_id"], tuple(r)[1:]) for r in license_scan.digest(found).collect()), key=repr)


def license_want(rows):
    out = []
    for d, t in rows:
        base = brute.license_base(t)
        labels, best = brute.template_matches(t, license_scan.TEMPLATES, license_scan.THRESHOLD)
        labels |= set(filter(None, base[4].split(",")))
        out.append((d, (*base, ",".join(sorted(labels)), best)))
    return sorted(out, key=repr)


def test_license_scan_matches_brute_force(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    want = license_want(rows)
    assert license_rows(license_scan.scan(docs, license_scan.token_order(docs))) == want
    assert sum(w[1][1] > 0 for w in want) > 5


def test_license_scan_odd_rows(spark):
    long = "filler " * 90 + "Licensed under the Apache License, Version 2.0. " + "more " * 90
    texts = [*ODD_TEXTS, long, long]
    docs = odd(spark, texts)
    got = license_rows(license_scan.scan(docs, license_scan.token_order(docs)))
    assert got == license_want([(i if i != 3 else None, t) for i, t in enumerate(texts)])
    assert license_scan.scan(docs.limit(0), license_scan.token_order(docs.limit(0))).count() == 0


def secret_rows(found):
    return sorted(((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in secrets.digest(found).collect()), key=repr)


def test_secrets_match_brute_force(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    found = secrets.scan(docs, secrets.train(docs)).persist()
    want = sorted(((d, *brute.secret_base(t)[:4]) for d, t in rows), key=repr)
    assert secret_rows(found) == want
    assert sum(w[1] + w[2] + w[3] for w in want) > 5
    texts = dict(rows)
    for r in secrets.digest(found).collect():
        base = brute.secret_base(texts[r["doc_id"]])[4]
        spans = r["spans"].split(",") if r["spans"] else []
        assert ",".join(s for s in spans if not s.startswith("random")) == base
        assert [int(s.split(":")[1]) for s in spans] == sorted(int(s.split(":")[1]) for s in spans)


def plain_parts(value, ratios, limit):
    """Random parts of a run by a plain loop."""
    value = re.sub(secrets.UUID, lambda m: "\u00b7" * 36, value)
    total = top = begin = end = 0
    out = []
    for i, (a, b) in enumerate(zip(value, value[1:])):
        total += ratios[ord(a) * 128 + ord(b)] if max(a, b) < "\x80" else -1e9
        if total <= 0 or total < top - limit:
            out += [(begin, end)] if top >= limit and end - begin >= 8 else []
            total, top, begin, end = 0, 0, i + 1, i + 1
        elif total > top:
            top, end = total, i + 2
    return out + ([(begin, end)] if top >= limit and end - begin >= 8 else [])


ORDINARY_NAMES = [
    "getConnectionManagerFactoryBuilderInstance", "number_of_training_examples_per_batch", "3f2504e0-4f89-41d3-9a0c-0305e82c3301",
    "https://example.com/index", "/usr/local/share/applications/config/settings.json", "AbstractSingletonProxyFactoryBean", "MAX_RETRY_COUNT",
    "spark-sql-shuffle-partitions", "pneumonoultramicroscopic", "user_id=12345", "/api/v2/customers/orders/history", "2023-01-15T12", "4785380592391139",
    "----------------", "================", "application/x-www-form-urlencoded", "x86_64-linux-gnu", "/files/3f2504e0-4f89-41d3-9a0c-0305e82c3301/index",
]


def test_model_tells_random_strings_from_names(spark, docs):
    ratios = secrets.train(docs)
    r = random.Random(5)
    alphabets = {"letters and digits": string.ascii_letters + string.digits, "hex": "0123456789abcdef"}
    made = {(name, n): ["".join(r.choices(alphabet, k=n)) for _ in range(60)] for name, alphabet in alphabets.items() for n in (10, 12, 16, 24, 40, 64)}
    behind = ["/reports/archive/latest/" + "".join(r.choices(alphabets["letters and digits"], k=24)) for _ in range(60)]
    texts = [*(v for vs in made.values() for v in vs), *behind, *ORDINARY_NAMES]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"] if s["kind"] == secrets.KINDS.index("random")] for r in secrets.scan(docs, ratios).collect()}
    runs = [[(m.start() + a, m.start() + b) for m in re.finditer(secrets.CANDIDATE.replace("}+", "}"), t) for a, b in plain_parts(m[0], ratios, 10.0)] for t in texts]
    assert [spans[k] for k in range(len(texts))] == runs
    at = 0
    for (name, n), vs in made.items():
        share = sum(bool(spans[k]) for k in range(at, at + len(vs))) / len(vs)
        assert share >= (0.9 if n >= 16 else 0.75 if n >= 12 else 0.6), (name, n, share)
        at += len(vs)
    for k in range(at, at + len(behind)):
        assert spans[k] and spans[k][-1][1] > 40 and spans[k][-1][0] > 15
    # one known false report, named in the README: its letter pairs hardly occur in this corpus
    assert [texts[k] for k in range(at + len(behind), len(texts)) if spans[k]] == ["AbstractSingletonProxyFactoryBean"]


def test_random_parts_beside_other_characters(spark, docs):
    ratios = secrets.train(docs)
    key = "qX7vZ2kP9sW4mB8tY3nL6"
    texts = ["é " * 4000 + key + " é" * 4000, f"{key}é{key}", "", None, f"word {key}"]
    got = {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"]] for r in secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), ratios).collect()}
    assert got[2] == got[3] == []
    for k, starts in ((0, [8000]), (1, [0, 22]), (4, [5])):
        assert len(got[k]) == len(starts) and all(s <= a < b <= s + 21 for s, (a, b) in zip(starts, got[k]))


def test_secrets_odd_rows(spark):
    docs = odd(spark)
    found = secrets.scan(docs, secrets.train(docs))
    assert secret_rows(found) == sorted(((i if i != 3 else None, *brute.secret_base(t)[:4]) for i, t in enumerate(ODD_TEXTS)), key=repr)
    assert secrets.scan(docs.limit(0), secrets.train(docs.limit(0))).count() == 0


def labels_of(text):
    words = license_scan.fold(text).split()
    order = {w: k for k, w in enumerate(sorted({w for _, t, _ in license_scan.TEMPLATES for w in t.encode().split()}))}
    index = license_scan.TemplateIndex(order, license_scan.TEMPLATES, license_scan.THRESHOLD)
    return {index.labels[k] for k, _ in index.matches(words)}


@pytest.mark.parametrize("text, want", [
    ("Licensed under CC BY-NC 4.0", {"cc-by-nc"}),
    ("released under the apache license", set()),
    ("released under the bsd license", set()),
    ("This work is licensed under the GNU Lesser General Public License version 3", {"lgpl"}),
    ("licensed under the gnu lesser general public license version 3", set()),
    ("licensed under the mozilla license version 2 0", set()),
    ("licensed under the eclipse public license version 2 0", set()),
    ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", {"lgpl"}),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", {"gpl"}),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", {"cc-by-nc"}),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License", {"cc-by"}),
])
def test_licenses_are_told_apart(text, want):
    assert labels_of(text) == want


def test_no_changed_word_makes_another_license():
    for label, template, marks in license_scan.TEMPLATES:
        words = template.split()
        assert labels_of(template) == {label}
        for at, word in enumerate(words):
            got = labels_of(" ".join([*words[:at], "other", *words[at + 1:]]))
            related = {"lgpl": {"gpl"}, "agpl": {"gpl"}, "cc-by-nc": {"cc-by"}, "cc-by-sa": {"cc-by"}, "cc-by-nd": {"cc-by"}}.get(label, set())
            assert got <= {label} | related
            assert label not in got or words.count(word) > 1 or word not in marks.split()


def test_license_texts_wrapped_over_lines(spark):
    texts = ["Permission is hereby granted, free of charge, to any person\nobtaining a copy of this software and associated documentation files", "x\n" * 40 + "Released under\nthe MIT\nlicense\n" + "y\n" * 90]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = license_rows(license_scan.scan(docs, license_scan.token_order(docs)))
    assert got == license_want(list(enumerate(texts)))
    assert [r[1][5] for r in got] == ["mit", "mit"]


def test_decontamination_unpacks_few_texts_at_once():
    import pyarrow as pa
    from ionweave.llm import decontaminate as D

    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(3 * D.ROWS_AT_ONCE + 7)), "text": ["a b"] * (3 * D.ROWS_AT_ONCE + 7)})
    parts = list(D._parts(iter([batch, batch.slice(0, 0)])))
    assert [p.num_rows for p in parts] == [D.ROWS_AT_ONCE] * 3 + [7]
    assert [i for p in parts for i in p.column("doc_id").to_pylist()] == batch.column("doc_id").to_pylist()
