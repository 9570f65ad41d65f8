"""Exact shingle near-duplicates, MinHash signatures, LSH, exact signature pairs, similarity graph."""

from __future__ import annotations

import functools
import random
import time

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievedeck.functions.text import jaccard, tokens, word_grams
from sievedeck.operators.index import spread
from sievedeck.session import discard, staged

PERMUTATIONS, PRIME = 50, (1 << 31) - 1
#: Parts of the hashes that shingles are counted in, one after the other; more take less disk and more time.
ROUNDS = 2


def constants(n: int = PERMUTATIONS, seed: int = 1) -> list[tuple[int, int]]:
    """(a, b) of the universal hash functions, from a seed."""
    r = random.Random(seed)
    return [(r.randrange(1, PRIME), r.randrange(PRIME)) for _ in range(n)]


def shingle_rows(df: DataFrame, k: int = 3, id_col: str = "doc_id", text_col: str = "text", joiner: str = " ") -> DataFrame:
    """doc_id, gram: the distinct k-word shingles of each document, words joined by ``joiner``."""
    docs = spread(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "doc_id")
    # Words are a column of their own: inside the lambda of word_grams they would be cut anew for each gram.
    words = docs.select("doc_id", tokens(F.col("text")).alias("words"))
    return words.select("doc_id", F.explode(F.array_distinct(word_grams(F.col("words"), k, joiner))).alias("gram"))


def _shared_shingles(df: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n, s: the number of distinct shingles and, sorted, the keys of those that another row has too.

    A key is a word of 64 bits: on top the size class of the shingle's frequency (its bits, rarest first), below
    60 bits of its hash. Shingles are counted in rounds of their own hashes each, so that the shuffle of all of them
    is never on disk at once; of those in one row only none is kept. Rows that share an id are one document.
    """
    docs = spread(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "doc_id")
    words = docs.select("doc_id", tokens(F.col("text")).alias("w"))
    hashes = F.transform("w", lambda w, i: F.xxhash64(w, *(F.get(F.col("w"), i + j) for j in range(1, k))))
    grams = words.select("doc_id", F.array_distinct(F.slice(hashes, F.lit(1), F.greatest(F.size("w") - (k - 1), F.lit(0)))).alias("g"))
    # Outer: else a filter on the arrays goes below all this, and words are cut anew for each gram.
    rows = grams.select("doc_id", F.size("g").alias("size"), F.posexplode_outer("g").alias("at", "h"))
    # The first shingle of a row bears their number, and stays for it.
    rows = rows.select("doc_id", F.when(F.col("at") == 0, F.col("size")).alias("n"), "h")
    rounds = []
    for turn in range(ROUNDS):
        part = rows.where(F.pmod("h", F.lit(ROUNDS)) == turn)
        part = part.select("*", F.count("*").over(Window.partitionBy("h")).alias("f")).where("f > 1 OR n IS NOT NULL")
        key = F.shiftleft((F.least(F.length(F.bin("f")), F.lit(16)) - 9).cast("long"), 60).bitwiseOR(F.col("h").bitwiseAND(F.lit((1 << 60) - 1)))
        rounds.append(staged(part.select("doc_id", "n", F.when(F.col("f") > 1, key).alias("key")), "shingles"))
    every = functools.reduce(DataFrame.unionByName, rounds)
    lists = every.groupBy("doc_id").agg(F.sum("n").alias("n"), F.collect_list("key").alias("all"))
    lists = lists.select("doc_id", "n", F.size("all").alias("size"), F.array_distinct("all").alias("s"))
    sets = staged(lists.select("doc_id", (F.col("n") - F.col("size") + F.size("s")).alias("n"), F.sort_array("s").alias("s")), "sets")
    discard(*rounds)
    return sets


def _equal_sets(sets: DataFrame) -> DataFrame:
    """doc_id, rep, n of the documents whose set another one has too; rep is the least of them."""
    marks = [F.xxhash64("s").alias("k1"), F.hash("s").alias("k2"), F.get("s", F.lit(0)).alias("k3"), F.get("s", F.size("s") - 1).alias("k4")]
    keyed = sets.where(F.size("s") == F.col("n")).select("doc_id", "n", *marks)
    keys = ["n", "k1", "k2", "k3", "k4"]
    classes = keyed.groupBy(*keys).agg(F.min("doc_id").alias("rep"), F.count("*").alias("c")).where("c > 1").drop("c")
    return staged(keyed.join(classes, keys).select("doc_id", "rep", "n"), "copies")


def shingle_pairs(df: DataFrame, threshold: float = 0.6, k: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """a, b, common, sim of the pairs a < b with similarity of the threshold or more.

    A prefix filter makes the join small: a pair that alike shares one of the rarest shingles of both
    sets, so only these prefixes are joined, and candidates are then counted in full. Of documents with
    equal sets the least stands for all in the joins; their pairs are made after them, as output only.
    """
    sets = _shared_shingles(df, k, id_col, text_col)
    copies = _equal_sets(sets)
    keep = F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1
    unique = F.col("n") - F.size("s")  # shingles of one document alone are the rarest of all
    prefix = sets.select("doc_id", "n", unique.alias("u"), F.slice("s", F.lit(1), F.greatest(F.lit(0), keep - unique).cast("int")).alias("p")).where(F.size("p") > 0)
    prefix = prefix.join(copies.where("doc_id <> rep").select("doc_id"), "doc_id", "left_anti")
    # left: how many shingles can still be common if this one is the first that is.
    prefix = prefix.select("doc_id", "n", "u", F.posexplode("p").alias("at", "key")).select("doc_id", "n", (F.col("n") - F.col("u") - F.col("at")).alias("left"), "key")
    left, right = prefix.toDF("a", "na", "la", "key"), prefix.toDF("b", "nb", "lb", "key")
    enough = F.least("la", "lb") >= (F.col("na") + F.col("nb")) * (threshold / (1 + threshold)) - 1e-6
    candidates = left.join(right, "key").where((F.col("a") < F.col("b")) & (F.least("na", "nb") >= threshold * F.greatest("na", "nb") - 1e-9) & enough).select("a", "b", "na", "nb").distinct()
    both = candidates.join(sets.select(F.col("doc_id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("s").alias("sb")), "b")
    counted = both.select("a", "b", "na", "nb", F.size(F.array_intersect("sa", "sb")).cast("long").alias("common"))
    counted = counted.select("a", "b", "common", (F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))).alias("sim")).where(F.col("sim") >= threshold)
    counted = staged(counted, "pairs")
    discard(sets)
    members = copies.select("doc_id", "rep")
    across = counted.join(members.toDF("x", "a"), "a", "left").join(members.toDF("y", "b"), "b", "left").select(F.coalesce("x", "a").alias("x"), F.coalesce("y", "b").alias("y"), "common", "sim")
    across = across.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "common", "sim")
    same = copies.toDF("a", "rep", "common").join(members.toDF("b", "rep"), "rep").where("a < b").select("a", "b", "common", F.lit(1.0).alias("sim"))
    return across.unionByName(same.where(F.col("sim") >= threshold))


def shingle_pairs_theta(df: DataFrame, k: int = 3, threshold: float = 0.6, max_docs: int = 1000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """a, b, sim, near_dup of all pairs, also those with nothing in common; refuses large tables."""
    if df.limit(max_docs + 1).count() > max_docs:
        raise ValueError(f"all pairs of more than {max_docs} documents; use shingle_pairs")
    words = df.select(F.col(id_col).alias("doc_id"), tokens(F.col(text_col)).alias("words"))
    sets = words.select("doc_id", F.array_distinct(word_grams(F.col("words"), k)).alias("s"))
    sim = jaccard(F.col("sa"), F.col("sb"))
    return sets.toDF("a", "sa").join(sets.toDF("b", "sb"), F.col("a") < F.col("b")).select("a", "b", sim.alias("sim"), F.coalesce(sim >= threshold, F.lit(False)).alias("near_dup"))


def minhash_signatures(df: DataFrame, k: int = 3, id_col: str = "doc_id", text_col: str = "text", short_docs: str = "match", permutations: int = PERMUTATIONS) -> DataFrame:
    """doc_id, sig: least hash of the k-word grams under each function.

    Fifty plain minima in one aggregation: partial sums before the shuffle, one row a document through it.
    Documents without a gram have the sentinel signature, which matches another such one; short_docs="drop" leaves them out.
    """
    base = F.conv(F.substring(F.md5(F.col("gram")), 1, 7), 16, 10).cast("long")
    rows = shingle_rows(df, k, id_col, text_col).select("doc_id", base.alias("x"))
    made = rows.groupBy("doc_id").agg(*(F.min((F.lit(a) * F.col("x") + F.lit(b)) % PRIME).alias(f"h{i}") for i, (a, b) in enumerate(constants(permutations))))
    made = made.select("doc_id", F.array(*(f"h{i}" for i in range(permutations))).alias("sig"))
    if short_docs == "drop":
        return made
    docs = df.select(F.col(id_col).alias("doc_id"))
    return docs.join(made, "doc_id", "left").select("doc_id", F.coalesce("sig", F.array_repeat(F.lit(PRIME).cast("long"), permutations)).alias("sig"))


def agreement(a, b):
    """Number of equal positions of two signatures."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, v: s + v)


def band_rows(sigs: DataFrame, edges: list[int]) -> DataFrame:
    """doc_id, band, bucket for the bands between the edges."""
    bands = [F.struct(F.lit(i).alias("band"), F.array_join(F.slice("sig", lo + 1, hi - lo), ",").alias("bucket")) for i, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False))]
    return sigs.select("doc_id", F.explode(F.array(*bands)).alias("x")).select("doc_id", "x.band", "x.bucket")


def signature_classes(sigs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The signatures once each (doc_id, the least that has it, and sig), and doc_id, rep of every document."""
    classes = sigs.groupBy("sig").agg(F.min("doc_id").alias("rep"))
    return classes.select(F.col("rep").alias("doc_id"), "sig"), sigs.join(classes, "sig").select("doc_id", "rep")


def expand_classes(pairs: DataFrame, members: DataFrame, within: Column) -> DataFrame:
    """a, b, matches of documents from those of classes: every pair across two paired classes and inside each class.

    Equal documents are first paired here, after all joins on buckets, so copies cost their output alone.
    """
    across = pairs.join(members.toDF("x", "a"), "a").join(members.toDF("y", "b"), "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "matches")
    same = members.toDF("a", "rep").join(members.toDF("b", "rep"), "rep").where("a < b").select("a", "b", within.alias("matches"))
    return across.unionByName(same)


def _candidates(sigs: DataFrame, edges: list[int]) -> DataFrame:
    rows = band_rows(sigs, edges)
    return rows.toDF("a", "band", "bucket").join(rows.toDF("b", "band", "bucket"), ["band", "bucket"]).where("a < b").select("a", "b").distinct()


def _agreeing(sigs: DataFrame, pairs: DataFrame) -> DataFrame:
    both = pairs.join(sigs.toDF("a", "sa"), "a").join(sigs.toDF("b", "sb"), "b")
    return both.select("a", "b", agreement(F.col("sa"), F.col("sb")).alias("matches"))


def lsh_candidates(sigs: DataFrame, bands: int = 5, rows: int = 10) -> DataFrame:
    """a, b of the pairs that share a bucket."""
    return lsh_pairs(sigs, bands, rows).select("a", "b")


def lsh_pairs(sigs: DataFrame, bands: int = 5, rows: int = 10, verify_matches: int | None = None, permutations: int = PERMUTATIONS) -> DataFrame:
    """a, b, matches of the candidates; below the threshold too, unless verify_matches is given."""
    reps, members = signature_classes(sigs)
    out = expand_classes(_agreeing(reps, _candidates(reps, [i * rows for i in range(bands + 1)])), members, F.lit(permutations))
    return out if verify_matches is None else out.where(F.col("matches") >= verify_matches)


def signature_pairs(sigs: DataFrame, least: int, permutations: int = PERMUTATIONS) -> DataFrame:
    """a, b, matches of all pairs that agree in ``least`` positions or more, exactly.

    With at most permutations - least positions apart, one of permutations - least + 1 bands is
    equal throughout, so an equi-join on that many bands finds every pair.
    """
    parts = permutations - least + 1
    edges = [i * permutations // parts for i in range(parts + 1)]
    reps, members = signature_classes(sigs)
    return expand_classes(_agreeing(reps, _candidates(reps, edges)).where(F.col("matches") >= least), members, F.lit(permutations))


def signature_of(sigs: DataFrame, doc_id) -> DataFrame:
    """The signature of one document, looked up by its id."""
    return sigs.where(F.col("doc_id") == F.lit(doc_id)).select("doc_id", "sig")


def list_pairs(pairs: DataFrame, n: int = 10) -> DataFrame:
    """The first n pairs by a, then b."""
    return pairs.orderBy("a", "b").limit(n)


def timed_pairs(pairs: DataFrame) -> tuple[int, float]:
    """How many pairs there are, and the seconds it took to find them all."""
    began = time.perf_counter()
    return pairs.count(), time.perf_counter() - began


def similarity_graph(pairs: DataFrame, permutations: int = PERMUTATIONS, least: int = 36) -> tuple[DataFrame, DataFrame]:
    """Edges (a, b, weight) of the pairs with more than 0.7 (36 of 50 positions), and vertices (v, degree)."""
    edges = pairs.where(F.col("matches") >= least).select("a", "b", (F.col("matches") / F.lit(float(permutations))).alias("weight"))
    ends = edges.select(F.explode(F.array("a", "b")).alias("v"))
    return edges, ends.groupBy("v").agg(F.count("*").alias("degree"))
