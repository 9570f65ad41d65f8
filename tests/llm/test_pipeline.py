import collections
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from sievedeck.llm import packing
from tests.llm.conftest import odd_rows, table
from tests.llm.test_dedup import copies, near_copies, slow_near, slow_passages, slow_substrings, unique_ids


def cut_words(text, window=20, seen=None):
    """A text without its repeated words, each with the white space after it."""
    spans = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    ws = [text[a:b] for a, b in spans]
    gone = [False] * len(ws)
    for a in range(len(ws) - window + 1):
        key = tuple(ws[a : a + window])
        if key in seen:
            gone[a : a + window] = [True] * window
        seen.add(key)
    out, at = [], 0
    for k, (a, _) in enumerate(spans):
        end = spans[k + 1][0] if k + 1 < len(spans) else len(text)
        out.append(text[at:a])
        out.append("" if gone[k] else text[a:end])
        at = end
    return "".join(out) + text[at:], sum(gone), len(ws)


def slow_pipeline(rows):
    """The stages after toxicity, one document after the other."""
    docs = {i: t for i, t in rows}
    kept = slow_passages(rows)
    docs = {i: kept[i][2] for i in docs if not kept[i][1] or kept[i][2]}
    near = slow_near(sorted(docs.items()), 5)
    docs = {i: t for i, t in docs.items() if near[i][2]}
    seen, out = set(), {}
    for i, t in sorted(docs.items()):
        left, removed, n = cut_words(t or "", seen=seen)
        if not removed or removed < n:
            out[i] = left if removed else t
    return out


@pytest.mark.parametrize("make", [lambda: copies(21, 80), lambda: unique_ids(odd_rows()), lambda: near_copies(6, 10)])
def test_pipeline_against_brute_force(spark, tmp_path, make):
    rows = make()
    table(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i, _ in rows], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    want = collections.Counter()
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, text in slow_pipeline(rows).items():
        ids = tok.encode(text or "", add_special_tokens=False).ids + [2]
        for piece, (a, n) in enumerate(packing.cut_points(len(ids), 1024)):
            want[i, piece, a, n, zlib.crc32(np.array(ids[a : a + n], "<u4").tobytes())] += 1
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:4]:
        columns = docs.columns
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == columns
    left = {r["doc_id"]: (r["text"], r["n_chars"]) for r in docs.collect()}
    assert {i: t for i, (t, _) in left.items()} == slow_pipeline(rows)
    assert all(n == len(t or "") for t, n in left.values())


def test_the_slow_form_agrees_with_the_operators_one():
    rows = copies(3, 30)
    seen, slow = set(), slow_substrings(rows)
    for i, t in sorted(rows):
        left, removed, n = cut_words(t, seen=seen)
        assert (n, removed, hashlib.sha256(" ".join(left.split()).encode()).hexdigest()) == slow[i][:3]


def test_pipeline_of_rows_that_share_an_id(spark, tmp_path):
    """Repeated ids with texts of any length go through all stages."""
    rows = [(5, "short"), (5, " ".join(f"w{k}" for k in range(300))), (5, " ".join(f"w{k}" for k in range(200, 260))), (None, "no id"), (6, None)] + [(k // 2, t) for k, (_, t) in enumerate(copies(8, 20))]
    table(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(5, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in got} <= {i for i, _ in rows} and None in {r["doc_id"] for r in got}
