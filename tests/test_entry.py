import os
import random
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__
from sievedeck.plans import catalog

SF = "/root/testdata/sf0.001"
CHECKED = ["word_tokens", "search_topk", "rocchio_search", "kgram_jaccard", "edit_ratio_lcs", "sequence_ratio", "fuzzy_features", "page_clusters", "search_batch", "search_full_ranking", "tfidf_weights", "similarity_degree", "page_profile", "page_features", "keyword_stuffing", "cloaking_check", "kshingles", "shingle_jaccard_pairs", "minhash_pairs", "lsh_vs_bruteforce", "csv_roundtrip"]


def test_every_query_of_the_catalogue_is_registered():
    assert set(catalog.queries()) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_query(spark):
    assert __spark_entry__.entry(spark).columns == ["rank", "doc_id", "score"]


@pytest.mark.parametrize("name", CHECKED)
def test_against_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "part", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = catalog.queries()[name](spark, SF).toPandas(), con.sql(catalog.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = [sorted(map(str, x[columns].itertuples(index=False, name=None))) for x in (got, want)]
    assert rows[0] == rows[1]


def test_the_rest_stands_without_the_llm_folders(tmp_path):
    """A copy without them and with or without the pipeline imports, registers its queries and passes a test."""
    root = os.path.dirname(os.path.abspath(__spark_entry__.__file__))
    copy = tmp_path / "copy"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", "llm"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'search_topk' in q and 'pipeline' not in q and not any(n.startswith('op') for n in q); assert set(e.oracle_sql()) <= set(q)"
    for gone in (False, True):
        if gone and (copy / "corpus_pipeline.py").exists():
            os.remove(copy / "corpus_pipeline.py")
        subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, timeout=300)
    subprocess.run([sys.executable, "-m", "pytest", "-q", "tests/test_entry.py", "-k", "every_query or test_entry_query"], cwd=copy, check=True, timeout=300)


def test_cloaking_check_on_odd_pages(spark, tmp_path):
    """Urls that repeat or lack, percentages on ties, no HTML, space and letters that Java's patterns take otherwise."""
    nav = lambda n, cut: "x" * (n - cut) + "<nav>" + "y" * (cut - 11) + "</nav>"
    bodies = [nav(1440, 261), nav(4800, 270), nav(3200, 276), "a", "b", "a<nav>b</nav>", None, "", " \n", "\xa0a\xa0", "\va \x85", "a  ", "\f\ra\t", "x<ſcript>y</SCRIPT >z", "x<scripté>y</script>z", "x<NAV>y</nav\v>z", "x<scripts>y</script>z"]
    rows = [(k, "u" if 3 <= k <= 5 else None if k in (8, 9) else f"u{k}", body) for k, body in enumerate(bodies)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.sql(catalog.oracle_sql()["cloaking_check"])
    got = catalog.queries()["cloaking_check"](spark, str(tmp_path)).select(want.columns)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want.fetchall()))
    assert len(rows) == got.count() and any("18.12%" in r["report"] for r in got.collect())


def test_shingle_pairs_keep_no_texts_of_shingles(spark, tmp_path, monkeypatch):
    """What is staged is small: hashes only. Copies, near copies, ids that two rows share, repeats, short texts and none."""
    kept = []
    monkeypatch.setattr(catalog.shingles, "staged", lambda df, name, f=catalog.shingles.staged: kept.append(df) or f(df, name))
    r = random.Random(5)
    texts = [" ".join(r.choices(["Ab", "cd", "ef", "gh-ij", "É", "k_1"], k=40)) for _ in range(6)]
    texts += [" ".join(w if r.random() > 0.03 else "new" for w in t.split()) for t in texts for _ in range(4)] + texts[:3] * 3 + ["a a a a a", "a a a", "b c", "", None, "A, a; a!"]
    rows = [(k if k % 9 else 1000 + k // 18, t) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(catalog.oracle_sql()["shingle_jaccard_pairs"])
    got = catalog.queries()["shingle_jaccard_pairs"](spark, str(tmp_path)).select(want.columns)
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted(want.fetchall()) and len(rows) > 40
    assert kept and not any("string" in kind for df in kept for _, kind in df.dtypes)
