import html as stdlib_html
import random
import re
import threading
import zipfile
from html.parser import HTMLParser
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sievedeck.functions import text as T
from sievedeck.operators import fuzzy, pages, shingles
from sievedeck.operators.index import TfidfIndex, parse_ranks, positions, preprocess
from sievedeck.sources import files
from sievedeck.streaming import pages as page_streams

TEN = [
    "Mira paints boats and sells small cards in spring.", "Two trains left the valley before the snow came down.", "A good soup needs salt, time and a large pot.",
    "Old maps show rivers where roads run these days.", "The clock in the tower stops at noon.", "Every autumn the geese cross the lake in long lines.", "Bread rises best in a warm and quiet kitchen.",
    "Nobody knew who had left the lamp burning.", "Mira paints boats and sells large prints after spring.", "Mira paints boats and sells old frames near harbours.",
]


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_exact_shingles_of_ten_sentences(spark):
    df = docs(spark, TEN)
    alike = {(r["a"], r["b"]): round(r["sim"], 4) for r in shingles.shingle_pairs_theta(df).collect() if r["sim"]}
    assert alike == {(0, 8): 0.2727, (0, 9): 0.2727, (8, 9): 0.2727}
    assert shingles.shingle_pairs(df).collect() == []
    low = {(r["a"], r["b"]): (r["common"], round(r["sim"], 4)) for r in shingles.shingle_pairs(df, 0.25).collect()}
    assert low == {p: (3, 0.2727) for p in alike}
    with pytest.raises(ValueError):
        shingles.shingle_pairs_theta(df, max_docs=5)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=9).map(" ".join), min_size=2, max_size=9), st.sampled_from([0.3, 0.6, 1.0]))
def test_prefix_filtered_pairs_are_all_pairs(spark, texts, threshold):
    df = docs(spark, texts)
    want = {(r["a"], r["b"]) for r in shingles.shingle_pairs_theta(df).collect() if (r["sim"] or 0) >= threshold}
    assert {(r["a"], r["b"]) for r in shingles.shingle_pairs(df, threshold).collect()} == want


def test_stuffing(spark):
    rows = ["b a a b", " ".join(["x"] * 3 + [f"w{k}" for k in range(17)]), None, "", "!!"]
    got = {r["doc_id"]: r for r in pages.keyword_stuffing(docs(spark, rows)).collect()}
    assert (got[0]["word"], got[0]["freq"], got[0]["ratio"], got[0]["stuffed"]) == ("b", 2, 0.5, True)
    assert (got[1]["ratio"], got[1]["stuffed"]) == (0.15, False)
    assert [got[k]["report"] for k in (3, 4)] == ["no words"] * 2 and not any(got[k]["stuffed"] for k in (2, 3, 4))


def test_tokens_and_grams(spark):
    row = docs(spark, ["éà_1 ß متن Aa a"]).select(T.tokens(F.col("text")).alias("t")).first()
    assert row["t"] == ["éà_1", "ß", "متن", "aa", "a"]
    g = docs(spark, ["a b c d", "a b"]).select(T.word_grams(F.split("text", " "), 3).alias("g"), T.char_grams(F.col("text")).alias("c")).collect()
    assert [r["g"] for r in g] == [["a b c", "b c d"], []]
    assert g[1]["c"] == ["a b"]
    kept = docs(spark, ["a"]).select(T.without_stop_words(F.array(*map(F.lit, ["و", "x", "x", "در"]))).alias("k")).first()
    assert kept["k"] == ["x", "x"]


HTML = '<p> a </p><p>b&amp;c</p><a href="http://x">1</a><a href=\'/p?u=http://y\'>2</a><a href=HTTP://Z>3</a><a name=q>4</a>'


def test_pages(spark):
    df = spark.createDataFrame(
        [("u1", HTML, None), ("u2", '<script src="a.js">var x</script>t', None), ("u3", "AJAX", None), ("u4", "<script>ab</script><!-- c -->", None), ("u5", None, "timeout")], "url string, html string, error string"
    )
    got = {r["url"]: r for r in pages.page_profile(df, error_col="error").collect()}
    assert (got["u1"]["text_length"], got["u1"]["outgoing_links"], got["u1"]["total_links"]) == (8, 1, 3)
    assert [got[u]["is_dynamic"] for u in ("u1", "u2", "u3", "u4")] == [False, True, True, False]
    assert got["u4"]["text_length"] == 0 and got["u5"]["error"] == "timeout" and got["u5"]["text_length"] is None
    feats = {r["url"]: (r["word_count"], r["mode_freq"], r["http_links"]) for r in pages.page_features(df.drop("error"), "url").collect()}
    assert feats["u1"] == (7, 1, 2) and feats["u4"] == (0, 0, 0)
    stats = pages.profile_stats(pages.page_profile(df.where("url = 'u5'"), error_col="error")).first()
    assert stats["avg_text_length"] is None


def test_cloaking(spark):
    rows = [("a", "x" * 100, "x" * 90), ("b", "x" * 100, "x" * 89), ("c", " ", "x" * 5), ("d", "x", None)]
    df = spark.createDataFrame(rows, "url string, n string, b string")
    got = {r["url"]: (r["status"], r["suspicious"]) for r in pages.cloaking_check(df.select("url", F.col("n").alias("body")), df.select("url", F.col("b").alias("body"))).collect()}
    assert got == {"a": ("ok", False), "b": ("ok", True), "c": ("empty_normal", False), "d": ("error", False)}


def test_clusters(spark):
    df = spark.createDataFrame([(k, v, v) for k, v in enumerate([1, 2, 3, 100, 101])], "page_id long, word_count long, mode_freq long")
    for made in (pages.cluster_pages(df, ["word_count", "mode_freq"]), pages.lloyd(df, ["word_count", "mode_freq"])):
        assert [r["cluster"] for r in made.orderBy("page_id").collect()] == [0, 0, 0, 1, 1]


def test_search_and_feedback(spark, tmp_path):
    df = docs(spark, ["red apple pie", "red apple pie", "green pear tart", None, "apple cake", "nothing here"])
    index = TfidfIndex.build(df)
    top = index.search("red apple pie", 3).collect()
    assert [(r["rank"], r["doc_id"]) for r in top][:2] == [(0, 1), (1, 0)] and top[0]["score"] == 1.0
    assert [r["doc_id"] for r in index.search("zzz", 3).collect()] == [5, 4, 2]
    assert index.search("red").count() == 5
    none = [r["doc_id"] for r in index.feedback_search("red apple", [], [], 5).collect()]
    assert none == [r["doc_id"] for r in index.search("red apple", 5).collect()]
    moved = index.feedback_search("apple", [0], [2], 5).collect()
    assert moved[0]["doc_id"] == index.search("apple", 1).first()["doc_id"]
    vector = index.query_vector("apple")
    away = {r["term"]: r["w"] for r in index.rocchio(vector, None, df.where("doc_id = 2").select("doc_id")).collect()}
    assert away["pear"] < 0 < away["apple"]
    with pytest.raises(ValueError):
        index.feedback_search("apple", [-1], [])
    index.save(str(tmp_path))
    assert TfidfIndex.load(spark, str(tmp_path)).search("pear", 1).first()["doc_id"] == 2
    batch = {(r["query_id"], r["rank"]): r["doc_id"] for r in index.search_batch(spark.createDataFrame([(7, "pear"), (8, "zzz")], "query_id long, text string"), 2).collect()}
    assert batch == {(7, 0): 2, (7, 1): 5, (8, 0): 5, (8, 1): 4}


def test_vocabulary_bounds(spark):
    df = docs(spark, [f"all {'most' if k < 17 else ''} {'pair' if k < 2 else ''} only{k}" for k in range(20)])
    assert {r["term"] for r in TfidfIndex.build(df, min_df=2, max_df=0.85).vocab.collect()} == {"most", "pair"}


def test_preprocess(spark):
    lemmas = spark.createDataFrame([("cats", "cat")], "surface string, lemma string")
    out = preprocess(docs(spark, ["the  cats و ran", "و"]), stop_words=T.STOP_WORDS, lemmas=lemmas).orderBy("doc_id").collect()
    assert [r["text"] for r in out] == ["the cat ran", ""]
    assert positions(spark.createDataFrame([("b",), ("a",)], "t string"), "t").orderBy("doc_id").first()["t"] == "a"


def test_fuzzy(spark):
    names = ["machine learning", "deep learning", "learning machine", "data mining", "machin lernng", ""]
    vectors = spark.createDataFrame([("machin", [1.0, 0.0]), ("machine", [1.0, 1.0])], "word string, vector array<double>")
    got = {r["query"]: r for r in fuzzy.fuzzy_features(spark.createDataFrame([(n,) for n in names], "category string"), "machin lernng", vectors=vectors).collect()}
    want = {"machine learning": (0.25, -0.8966, 0.90), "deep learning": (0.0476, -0.5385, 0.54), "learning machine": (0.1905, -0.4828, 0.48), "data mining": (0.0, -0.4167, 0.42), "machin lernng": (1.0, -1.0, 1.0), "": (0.0, 0.0, 0.0)}
    assert {n: (r["k_gram"], r["noise"] + 0.0, r["sound"]) for n, r in got.items()} == want
    assert got["machine learning"]["semantic"] == 0.7071 and got["data mining"]["semantic"] == 0.0
    ratio = spark.createDataFrame([(n,) for n in names], "s string").select("s", F.round(T.indel_ratio(F.col("s"), "machin lernng"), 4).alias("r")).collect()
    assert {r["s"]: r["r"] for r in ratio} == {n: -x[1] for n, x in want.items()}


def test_signature_pairs_and_lsh(spark):
    base = list(range(50))
    rows = [(0, base)] + [(k, [v if i < same else 1000 * k + i for i, v in enumerate(base)]) for k, same in ((1, 35), (2, 36), (3, 39), (4, 40), (5, 50))]
    sigs = spark.createDataFrame(rows, "doc_id long, sig array<long>")
    of = lambda df: {r["b"] for r in df.collect() if r["a"] == 0}
    assert of(shingles.signature_pairs(sigs, 36)) == {2, 3, 4, 5} and of(shingles.signature_pairs(sigs, 40)) == {4, 5}
    assert of(shingles.lsh_pairs(sigs)) == {1, 2, 3, 4, 5} and of(shingles.lsh_pairs(sigs, verify_matches=40)) == {4, 5}
    edges, vertices = shingles.similarity_graph(shingles.signature_pairs(sigs, 36))
    assert {r["v"] for r in vertices.collect()} <= {0, 1, 2, 3, 4, 5} and edges.count() >= 4
    short = shingles.minhash_signatures(docs(spark, ["a b", "", "x y z"]))
    assert short.count() == 3 and shingles.minhash_signatures(docs(spark, ["a b", "", "x y z"]), short_docs="drop").count() == 1
    assert {(r["a"], r["b"]) for r in shingles.signature_pairs(short, 50).collect()} == {(0, 1)}


def test_files(spark, tmp_path):
    df = docs(spark, ['say "hi",\nthere', "NA", None, "plain, text", "x\\y"])
    files.write_csv(df, str(tmp_path / "c"))
    assert {r["text"] for r in files.read_csv(spark, str(tmp_path / "c"), "doc_id long, text string").collect()} == {'say "hi",\nthere', None, "plain, text", "x\\y"}
    (tmp_path / "h").mkdir()
    (tmp_path / "h" / "a.html").write_bytes(b"<p>ok\xff</p>")
    (tmp_path / "h" / "b.txt").write_text("no")
    assert [tuple(r) for r in files.read_folder(spark, str(tmp_path / "h"), ".html").collect()] == [("a.html", "<p>ok</p>")]
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("d/para1.txt", "one")
        z.writestr("x.bin", "two")
    assert [tuple(r)[1:] for r in files.read_zip(spark, str(tmp_path / "z.zip"), ".txt").collect()] == [("d/para1.txt", "one")]
    files.write_folder(spark.createDataFrame([("n1", "line\nline"), ("n2", "é")], "filename string, text string"), str(tmp_path / "f"))
    assert {tuple(r) for r in files.read_named(spark, str(tmp_path / "f")).collect()} == {("n1", "line\nline"), ("n2", "é")}

    def fetch(url):
        if url == "bad":
            raise OSError("down")
        return "<p>x</p>"

    assert {tuple(r) for r in files.fetch_pages(spark.createDataFrame([("good",), ("bad",)], "url string"), fetch).collect()} == {("good", "<p>x</p>", None), ("bad", None, "down")}


ENTITY = ["&", "amp", ";", "&#233;", "&#xE9;", "&eacute;", "&eacute", "&notit;", "&notin;", "&#x27", "&#0;", "&#128;", "&#150;", "&#xD800;", "&#x110000;", "&#99999999999;", "&#x1F600;", "&nbsp;", "&lt;", "&LT", "&zzz;", "&#", "&#x;", "&#1;", "&#xFDD0;", " ", "a", "1", "é", "&nGt;", "&amp;lt;"]


def test_entities_as_the_standard_library_reads_them(spark):
    r = random.Random(1)
    texts = [*ENTITY, *("".join(r.choices(ENTITY, k=r.randrange(7))) for _ in range(1500))]
    got = docs(spark, texts).select("text", pages.decode_entities(F.col("text")).alias("d")).collect()
    assert [r["d"] for r in got] == [stdlib_html.unescape(r["text"]) for r in got]


class Slow(HTMLParser):
    """Text nodes, targets and script sources as the standard parser sees them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes, self.links, self.sources, self.hidden = [], [], False, ""

    def handle_starttag(self, tag, attrs):
        if tag == "a" and "href" in dict(attrs):
            self.links.append(dict(reversed(attrs))["href"] or "")
        self.sources |= tag == "script" and "src" in dict(attrs)
        self.hidden = tag if tag in ("script", "style") else self.hidden
        self.nodes.append("")

    def handle_endtag(self, tag):
        self.hidden = "" if tag == self.hidden else self.hidden
        self.nodes.append("")

    def handle_comment(self, data):
        self.nodes.append("")

    def handle_decl(self, decl):
        self.nodes.append("")

    def handle_data(self, data):
        if not self.hidden:
            self.nodes[-1:] = [(self.nodes or [""])[-1] + data]


PART = [
    "<p>", "</p>", " some  words ", "caf&eacute; &#38; bar", "<a href='http://x/?a=1&amp;b=2'>", "<a title='1 > 0' href=\"/y\">", '<a href=z class="q">', "<a name=n>", "</a>", "<br/>", "<!-- a > b <p> -->",
    "<script>if (a < b) { c('<p>x</p>') }</script>", '<script src="s.js"></script>', "<script data-src=k>var a</script>", "<style>p > b {}</style>", "1 < 2", "a &lt; b", '<img alt="x > y" src="i.png">', "<td data-href='no'>", "é\n", "<!DOCTYPE html>",
    "<A HREF='HTTP://Q'>", "<a data-href='http://no' href='http://yes'>",
]


def test_pages_as_the_standard_parser_reads_them(spark):
    r = random.Random(2)
    texts = [*PART, *("".join(r.choices(PART, k=r.randrange(10))) for _ in range(1500))]
    df = spark.createDataFrame(list(enumerate(texts)), "url long, html string")
    rows = df.select("html", pages.text_length(F.col("html")).alias("n"), pages.hrefs(F.col("html")).alias("links"), pages.is_dynamic(F.col("html")).alias("dynamic"), T.tokens(pages.page_text(F.col("html"))).alias("words")).collect()
    for r in rows:
        slow = Slow()
        slow.feed(r["html"])
        slow.close()
        assert r["n"] == sum(len(x.strip()) for x in slow.nodes), r["html"]
        assert r["links"] == slow.links and r["dynamic"] == slow.sources, r["html"]
        assert r["words"] == re.findall(r"\w+", " ".join(slow.nodes).lower()), r["html"]


def test_open_scripts_and_long_tags(spark):
    texts = ["a<script>b<p>c", "x<!-- never closed <p>y", "<a " + "q='" + "z>" * 20000 + "' href=h>t</a>", "<" * 3000, "<a href='" + "x" * 50000]
    got = docs(spark, texts).select(pages.text_length(F.col("text")).alias("n"), pages.hrefs(F.col("text")).alias("l")).collect()
    assert [r["n"] for r in got[:3]] == [1, 1, 1] and got[2]["l"] == ["h"]


def test_reports(spark):
    df = spark.createDataFrame([("a", "x" * 100, "x" * 50), ("b", "xy", "xy"), ("c", " ", "x"), ("d", "x", None)], "url string, n string, b string")
    got = {r["url"]: r["report"] for r in pages.cloaking_check(df.select("url", F.col("n").alias("body")), df.select("url", F.col("b").alias("body"))).collect()}
    assert got["a"].split("\n") == ["normal response: 100 characters", "response for bots: 50 characters", "difference: 50.00%", "more than 10% apart, which may be cloaking"]
    assert got["b"].endswith("difference: 0.00%\nno large difference") and got["c"] == "the normal response is empty" and got["d"] == "a response is missing"
    full = pages.cloaking_check(spark.createDataFrame([("u", "n" * 600)], "url string, body string"), spark.createDataFrame([("u", "m" * 600)], "url string, body string")).first()
    assert (full["normal_preview"], full["bot_preview"]) == ("n" * 500, "m" * 500)


def test_ranks_lookups_and_listings(spark):
    assert parse_ranks(" 0  2 ") == [0, 2] and parse_ranks("") == [] and parse_ranks(None) == []
    for bad in ("1 -2", "x"):
        with pytest.raises(ValueError):
            parse_ranks(bad)
    df = docs(spark, ["red apple pie", "red apple tart", "green pear tart", "apple cake"])
    index = TfidfIndex.build(df).staged()
    assert index.feedback_search("apple", "0", "2", 4).collect() == index.feedback_search("apple", [0], [2], 4).collect()
    assert index.search("apple", 4).collect() == TfidfIndex.build(df).search("apple", 4).collect()
    index.discard()
    sigs = shingles.minhash_signatures(docs(spark, ["a b c d"] * 3 + ["x y z"]))
    assert [r["doc_id"] for r in shingles.signature_of(sigs, 3).collect()] == [3] and shingles.signature_of(sigs, 9).collect() == []
    pairs = shingles.signature_pairs(sigs, 36)
    assert [(r["a"], r["b"], r["matches"]) for r in shingles.list_pairs(pairs, 2).collect()] == [(0, 1, 50), (0, 2, 50)]
    n, seconds = shingles.timed_pairs(pairs)
    assert n == 3 and seconds > 0
    assert {r["gram"] for r in shingles.shingle_rows(docs(spark, ["a b c d"]), joiner="_").collect()} == {"a_b_c", "b_c_d"}


def test_positions_count_over_ranges(spark):
    r = random.Random(4)
    names = [f"n{r.randrange(10**9)}" for _ in range(500)]
    got = positions(spark.createDataFrame([(n, 1) for n in names], "t string, x int").repartition(7), "t").collect()
    assert [x["t"] for x in sorted(got, key=lambda x: x["doc_id"])] == sorted(names) and {x["doc_id"] for x in got} == set(range(500))
    assert positions(spark.createDataFrame([], "t string"), "t").collect() == []


def test_copies_expand_to_all_pairs(spark):
    sigs = spark.createDataFrame([(k, [1] * 50) for k in range(30)] + [(100 + k, [1] * 45 + [2] * 5) for k in range(20)] + [(200, [3] * 50)], "doc_id long, sig array<long>")
    want = {(a, b): 50 if (a < 100) == (b < 100) else 45 for a in [*range(30), *range(100, 120)] for b in [*range(30), *range(100, 120)] if a < b}
    for got in (shingles.signature_pairs(sigs, 40), shingles.lsh_pairs(sigs)):
        rows = [(r["a"], r["b"], r["matches"]) for r in got.collect()]
        assert len(rows) == len(want) and {(a, b): m for a, b, m in rows} == want


def test_tokenizer_and_persian_normaliser(spark):
    out = preprocess(docs(spark, ["كتاب  يك", "a-b c"]), normalizer=T.normalize_persian, tokenizer=lambda t: F.split(t, r"[\s-]+")).orderBy("doc_id").collect()
    assert [r["text"] for r in out] == ["کتاب یک", "a b c"]


class Echo(BaseHTTPRequestHandler):
    def do_GET(self):  # noqa: N802
        body = f"<p>{self.headers['User-Agent']} café</p>".encode("latin-1")
        self.send_response(404 if self.path == "/none" else 200)
        self.send_header("Content-Type", "text/html; charset=latin-1")
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_):
        pass


def test_fetching_as_two_agents(spark):
    server = HTTPServer(("127.0.0.1", 0), Echo)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        root = f"http://127.0.0.1:{server.server_port}"
        urls = spark.createDataFrame([(f"{root}/a",), (f"{root}/none",), ("http://127.0.0.1:1/",), ("no url",)], "url string")
        normal, bot = files.fetch_twice(urls)
        for snapshot, agent in ((normal, files.NORMAL_AGENT), (bot, files.BOT_AGENT)):
            rows = {r["url"]: r for r in snapshot.collect()}
            assert rows[f"{root}/a"]["body"] == rows[f"{root}/none"]["body"] == f"<p>{agent} café</p>"
            assert all(rows[u]["body"] is None and rows[u]["error"] for u in ("http://127.0.0.1:1/", "no url"))
        status = {r["url"]: r["status"] for r in pages.cloaking_check(normal, bot).collect()}
        assert status == {f"{root}/a": "ok", f"{root}/none": "ok", "http://127.0.0.1:1/": "error", "no url": "error"}
        fetched = files.fetch_pages(urls)
        profiles = pages.page_profile(fetched, error_col="error")
        assert {r["url"]: r["error"] is None for r in profiles.collect()} == {u: s == "ok" for u, s in status.items()}
    finally:
        server.shutdown()


def test_records_of_different_columns(spark):
    good = spark.createDataFrame([("u1", 5)], "url string, text_length long")
    bad = spark.createDataFrame([("u2", "timeout")], "url string, error string")
    assert {tuple(r) for r in files.union_records(good, bad).collect()} == {("u1", 5, None), ("u2", None, "timeout")}


def test_page_streams(spark, tmp_path):
    schema = "url string, html string, fetched timestamp"
    rows = [("a", "<p>abc</p><a href='http://x'>d</a>", "2024-01-01 10:05:00"), ("b", "<p>ab</p>", "2024-01-01 10:50:00"), ("c", "x", "2024-01-01 12:00:00")]
    df = spark.createDataFrame(rows, "url string, html string, t string").select("url", "html", F.to_timestamp("t").alias("fetched"))
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    profiles = page_streams.profile_stream(page_streams.read_pages(spark, str(tmp_path / "in"), schema, 1))
    profiles.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    got = {r["url"]: (r["text_length"], r["outgoing_links"], r["is_dynamic"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"a": (4, 1, False), "b": (2, 0, False), "c": (1, 0, False)}
    windows = page_streams.profile_windows(page_streams.profile_stream(page_streams.read_pages(spark, str(tmp_path / "in"), schema)))
    windows.writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start().awaitTermination()
    assert {(r["start"].hour, r["pages"], r["avg_text_length"]) for r in spark.table("windows").collect()} == {(10, 2, 3.0), (12, 1, 1.0)}
