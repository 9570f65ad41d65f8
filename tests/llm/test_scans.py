import hashlib
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sievedeck.llm import docorder, fingerprints, licences
from tests.llm.conftest import odd_rows, table


def slow_canonical(text):
    fold = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(re.split(r"[\s   -     　]+", fold)).strip()


def test_fingerprints_group_canonical_texts(spark, odd, empty):
    texts = ["Straße  ", "strasse", "STRASSE\n", "été", "ÉTÉ", "ﬁn", "fin", "ｆｉｎ", "Å", "Å", "a b", "a　b", "", " \n", None, "x", "각", "각"]
    rows = fingerprints.with_fingerprint(table(spark, list(enumerate(texts)))).select("doc_id", "text", "fingerprint").collect()
    by_text, by_print = {}, {}
    for r in rows:
        by_text.setdefault(slow_canonical(r["text"] or ""), set()).add(r["fingerprint"])
        by_print.setdefault(r["fingerprint"], set()).add(slow_canonical(r["text"] or ""))
    assert all(len(x) == 1 for x in [*by_text.values(), *by_print.values()])
    assert fingerprints.with_fingerprint(odd).count() == odd.count() and fingerprints.with_fingerprint(empty).collect() == []


def test_colliding_digests_are_told_apart(spark):
    rows = spark.createDataFrame([("a", "0"), ("b", "0"), ("b", "0"), ("c", "1")], "canon string, digest string")
    mixed = fingerprints.mixed_digests(rows)
    assert [r["digest"] for r in mixed.collect()] == ["0"]
    made = [r["digest"] for r in fingerprints._settle(rows, "digest", "canon", mixed).orderBy("canon").collect()]
    assert len(set(made)) == 3 and made[-1] == "1"


@pytest.mark.parametrize("n", [1, 2, 17])
def test_edited_texts(spark, n):
    rows = sorted({i: t for i, t in odd_rows() if i is not None}.items())[:n]
    got = {r["doc_id"]: r for r in fingerprints.fingerprint_report(table(spark, rows)).collect()}
    for k, (i, text) in enumerate(rows):
        text, after = text or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert got[i]["n_chars"] == len(text) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        same = slow_canonical(text) == slow_canonical(edited)
        assert got[i]["near_edited"] == float(same) and (got[i]["fingerprint"] == got[i]["edited_fingerprint"]) == same
        assert got[i]["near_next"] == float(slow_canonical(text) == slow_canonical(after))


def test_edited_texts_of_odd_tables(spark, odd, empty):
    assert fingerprints.fingerprint_report(odd).count() == odd.count()
    assert fingerprints.fingerprint_report(empty).collect() == []


@pytest.mark.parametrize("ids", [list(range(500)), [k * k * k for k in range(300)], [-(1 << 62), 0, 1, 1 << 62], [5] * 40, [None, 3]])
def test_order_buckets_rise_with_ids(spark, ids):
    df = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    got = df.select("doc_id", docorder.order_buckets(df, "doc_id", 20, 8).alias("b")).orderBy(F.col("doc_id").asc_nulls_first()).collect()
    buckets = [r["b"] for r in got]
    assert buckets == sorted(buckets) and all((r["b"] == -1) == (r["doc_id"] is None) for r in got)


def test_licence_families(spark):
    lines = {
        "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT", "All rights reserved.": "Proprietary",
        "This work is licensed under the GNU General Public License, version 3.": "GPL", "Licensed under CC BY-NC 4.0.": "CC-BY-NC", "Released under the BSD 3-clause license.": "BSD",
        "Licensed under CC BY-SA 4.0": "CC-BY-SA", "He got his driving license in May.": None, "Copyright law is debated in parliament.": None, "Nothing here.": None,
    }
    df = table(spark, [(k, f"Some words first.\n{x}\nMore words.") for k, x in enumerate(lines)])
    rows = {r["doc_id"]: r for r in licences.licence_scan(df).collect()}
    assert [rows[k]["families"] or None for k in range(len(lines))] == list(lines.values())
    assert all(r["n_paragraphs"] == 3 for r in rows.values())


def slow_verdict(text):
    """The verdict of one paragraph from the weights, in plain Python; None for other text."""
    m, own = licences.model(), set(licences.grams(text))
    z = [b + sum(m["weights"][g][k] for g in own if g in m["weights"]) for k, b in enumerate(m["bias"])]
    e = [np.exp((x - max(z)) / m["temperature"]) for x in z]
    p = [x / sum(e) for x in e]
    if p[-1] >= 0.5:
        return None
    families = p[: len(licences.TEMPLATES)]
    best = families.index(max(families))
    shares = [len(own & set(t)) / min(len(own), len(t)) for f, t in m["templates"] if f == best and len(own & set(t)) >= licences.LEAST_GRAMS]
    alike = max([0.0, *shares])
    strange = p[-2] > families[best] or round(families[best], 6) < m["threshold"]
    return None if strange else licences.FAMILIES[best], families[best], alike, "unknown" if strange else "confirmed" if alike >= licences.CONFIRM else "unconfirmed"


def test_licence_verdicts_against_brute_force(spark):
    r = np.random.default_rng(1)
    texts = [v for own in licences.TEMPLATES.values() for v in own] + licences.OTHER + [t for _, t in licences.training_rows(r, 2)] + ["", "Mit.", "qq", "die mit der", "a" * 5000]
    got = {x["doc_id"]: x for x in licences.licence_paragraphs(table(spark, list(enumerate(texts)))).collect()}
    for k, text in enumerate(texts):
        want = slow_verdict(text) if text else None
        if want is None:
            assert k not in got, text
            continue
        x = got[k]
        assert x["family"] == want[0] and x["verdict"] == want[3], (text, x, want)
        assert abs(x["probability"] - want[1]) < 1e-5 and abs(x["similarity"] - want[2]) < 1e-5


NOTICES = {
    "MIT": ["This project is released under the MIT License.", "Code in this directory is licensed under the MIT license", "Permission is hereby granted, free of charge, to any person obtaining a copy of", "The dog ran home late. Released under the MIT License."],
    "Apache-2.0": ["Distributed under the Apache License, Version 2.0", "Licensed under the Apache License, Version 2.0 (the \"License\");", "unless required by applicable law or agreed to in writing, software"],
    "GPL": ["Our tool is licensed under the GNU General Public License version 2.", "it under the terms of the GNU General Public License as published by", "Released under the GPL, version 3"],
    "LGPL": ["This library is licensed under the GNU Lesser General Public License, version 3"],
    "AGPL": ["The server is licensed under the GNU Affero General Public License version 3"],
    "BSD": ["Released under the BSD 3-Clause License", "Redistribution and use in source and binary forms, with or without modification,"],
    "MPL-2.0": ["Licensed under the Mozilla Public License, version 2.0", "This Source Code Form is subject to the terms of the Mozilla Public"],
    "CC-BY": ["Text is licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA": ["Pictures are licensed under CC BY-SA 4.0.", "available under CC BY-SA 3.0"],
    "CC-BY-NC": ["Licensed under CC BY-NC-SA 4.0 by the author"],
    "CC0": ["Released under CC0 1.0", "Dedicated to the public domain under CC0 1.0 by the authors"],
    "Proprietary": ["Copyright 2020 The Authors. All rights reserved.", "This material is proprietary and confidential."],
}
STRANGE = ["Licensed under the Eclipse Public License 2.0", "Licensed under the Zebra Public License version 2.0", "Released under the Boost Software License"]
CLEAN = [
    "Mit.", "Den mit und der die.", "He lost his fishing license in May.", "Copyright law is hard to read.", "The apache flew over the hills and the river.", "They reserved a table for all of us.",
    "She works in the public domain of the town.", "The creative commons room was closed.", "An old man and the sea under the bridge", "Free software is a matter of taste", "le chat et la souris", "Version 3 of the map is out.",
]


def test_licence_precision_and_recall_on_planted_notices(spark):
    """Notices that no template has word for word, licences of no family here, and misleading text."""
    planted = [(f, t) for f, own in NOTICES.items() for t in own] + [("strange", t) for t in STRANGE] + [(None, t) for t in CLEAN]
    df = table(spark, [(k, f"Some words first.\n{t}\nMore words.") for k, (_, t) in enumerate(planted)])
    rows = {r["doc_id"]: r for r in licences.licence_scan(df).collect()}
    right = [k for k, (f, _) in enumerate(planted) if f in NOTICES and rows[k]["families"] == f]
    wrong = [t for k, (f, t) in enumerate(planted) if rows[k]["families"] not in ("", f)]
    assert not wrong
    assert len(right) >= 0.9 * sum(map(len, NOTICES.values())), [t for k, (f, t) in enumerate(planted) if f in NOTICES and k not in right]
    assert all(rows[k]["n_unknown"] + rows[k]["n_unconfirmed"] == 1 and rows[k]["families"] == "" for k, (f, _) in enumerate(planted) if f == "strange")
    assert not any(rows[k]["n_confirmed"] + rows[k]["n_unconfirmed"] for k, (f, _) in enumerate(planted) if f is None)


def test_licences_of_odd_tables(odd, empty):
    assert licences.licence_scan(odd).count() == odd.count()
    assert licences.licence_scan(empty).collect() == []


def test_pipeline(spark, tmp_path):
    table(spark, odd_rows()).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0), (4, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, before = docs.columns, docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert k == 4 or (docs.columns == columns and docs.count() <= before)
        before = docs.count()
    key = lambda r: (str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"])
    assert sorted(map(key, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(map(key, docs.collect()))
