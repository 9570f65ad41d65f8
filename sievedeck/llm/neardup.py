"""MinHash near-duplicates with odd sketches.

A document's set is its distinct ``words``-word shingles. Documents of equal sets are one
class, found by a wide order-free hash of the set. Each class has ``BANDS * ROWS``
MinHash samples whose bands are bucket keys, and ``BITS`` more from one permutation cut into
as many parts, the least shingle hash of each part. These are folded into a parity bitmap (an odd
sketch): where two bitmaps differ, the number of ones tells how many samples differ, precisely
for high similarities and exactly enough for short sets, of which nearly all shingles are samples.
Candidates that pass the sketch are verified on their full sets, shingles compared word by
word, so no link rests on an estimate or a hash.

Buckets never give all pairs. First each member meets the least member of its bucket in
``STAR_BANDS`` of the bands, which is linear in the bucket, and verified links make components. Only
members of buckets that still lie in several components go on to an exact join by prefixes:
their shingles are ordered by how many of them have each, rarest first, and a pair that is
similar enough shares a shingle so near the front of both orders that what follows can still
make up the required overlap. Rows are dealt by shingle and by classes of the two sizes, so a shingle that
stands too far back for partners of a size never meets them, and boilerplate that many documents
share, but that makes none of them similar enough, gives no pairs at all. What is left untested lies
within one component already, so components equal those of all links; with 32 bands of 4 samples a
link of similarity 0.8 shares no bucket with probability 5e-8.

Defined results: null and empty texts, and texts without words, have an empty
set and stay alone; texts with fewer words than a shingle have their whole word sequence as
one; rows that share an id are one place (links of each of their texts count); rows with a null id stay,
unlinked, with a null component; an empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievedeck.llm.joins import salted_join
from sievedeck.llm.textvec import LOWER, distinct_spans, mix, only, range_hash, sequence_hash, span_hash, text_slices, trim, words
from sievedeck.session import discard, ensure_importable, staged

BANDS, ROWS, BITS, STAR_BANDS = 32, 4, 2048, 8
SKETCH_WORDS = BITS // 64
_SEED = mix(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_FACTOR, _ADD = _SEED[: BANDS * ROWS] | np.uint64(1), _SEED[BANDS * ROWS :]


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit shingle hashes of all documents, one after another, and where each begins."""
    data = LOWER[data]
    starts, ends, doc = words(data, offs)
    n = len(offs) - 1
    h = span_hash(data, starts, ends)[0]
    base = np.searchsorted(doc, np.arange(n + 1))
    grams = sequence_hash(h, k)
    whole = doc[: len(grams)] == doc[k - 1 :] if len(grams) else np.zeros(0, bool)
    size = np.diff(base)
    short = np.flatnonzero((size > 0) & (size < k))
    items = np.concatenate([grams[whole], range_hash(h, base[short], base[short + 1]) if len(short) else grams[:0]])
    owner = np.concatenate([doc[: len(grams)][whole], short])
    order = np.lexsort((items, owner))
    items, owner = items[order], owner[order]
    new = np.ones(len(items), bool)
    new[1:] = (items[1:] != items[:-1]) | (owner[1:] != owner[:-1])
    items, owner = items[new], owner[new]
    return items, np.searchsorted(owner, np.arange(n + 1))


def band_keys(items: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Bucket keys (documents x BANDS) of the non-empty sets."""
    at = edges[:-1][np.diff(edges) > 0]
    buffer = np.empty_like(items)
    keys = np.empty((BANDS, len(at)), np.uint64)
    for b in range(BANDS):
        key = np.full(len(at), b + 1, np.uint64)
        for j in range(b * ROWS, (b + 1) * ROWS):
            np.multiply(items, _FACTOR[j], out=buffer)
            np.add(buffer, _ADD[j], out=buffer)
            key = mix(key ^ np.minimum.reduceat(buffer, at))
        keys[b] = key
    return keys.T.copy()


def odd_sketches(items: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Parity bitmaps (documents x SKETCH_WORDS) of the non-empty sets; items ascend within a set."""
    size = np.diff(edges)
    size = size[size > 0]
    owner = np.repeat(np.arange(len(size)), size)
    part = items >> np.uint64(64 - BITS.bit_length() + 1)
    least = np.ones(len(items), bool)
    least[1:] = (part[1:] != part[:-1]) | (owner[1:] != owner[:-1])
    bit = (mix(items[least] + np.uint64(1)) % np.uint64(BITS)).astype(np.int64)
    odd = np.bincount(owner[least] * BITS + bit, minlength=len(size) * BITS) & 1
    return np.packbits(odd.astype(bool).reshape(-1, BITS), axis=1, bitorder="little").view(np.uint64)


def sketch_bound(total: float, similarity: float) -> int:
    """Ones in the XOR of the sketches of two sets of so many shingles together that pairs of this similarity
    stay under: by five deviations of the samples and four of the bitmap."""
    union = total / (1 + similarity)
    load = union / BITS
    parts = min(union, BITS * (1 - np.exp(-load)))
    # Where nearly all shingles are samples, their share hardly varies.
    spread = np.sqrt(parts * similarity * (1 - similarity) * max(0.0, 1 - parts / union))
    apart = min(parts, parts * (1 - similarity) + 5 * spread + 1)
    differ = apart * (2 - np.exp(-load))
    once, twice = (1 - 2 / BITS) ** differ, (1 - 4 / BITS) ** differ
    variance = BITS / 4 * (1 - twice) + BITS**2 / 4 * (twice - once**2)
    return int(np.ceil(BITS / 2 * (1 - once) + 4 * np.sqrt(max(variance, 1))))


STEPS_AN_OCTAVE = 8


def sketch_bounds(similarity: float) -> list[int]:
    """Bounds by floor(8 * log2(total)), each for the largest total of its step."""
    return [max(sketch_bound(2 ** (k / STEPS_AN_OCTAVE), similarity) for k in (step, step + 1)) for step in range(40 * STEPS_AN_OCTAVE)]


def sketch_rows(df: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """doc_id, row (hash of the text), n_shingles, s1, s2 (hash of the set), keys, sketch of every document; no keys for empty sets."""
    def run(batches):
        only(("neardup",))
        for batch in batches:
            ids, texts = batch.column(0), batch.column(2)
            for row, stop, data, offs in text_slices(batch.column(1)):
                items, edges = shingle_sets(data, offs, k)
                n = np.diff(edges)
                some = np.flatnonzero(n)
                sums = [np.zeros(len(n), np.uint64) for _ in range(2)]
                keys, sketch = np.zeros((0, BANDS), np.uint64), np.zeros((0, SKETCH_WORDS), np.uint64)
                if len(some):
                    for s, salt in zip(sums, (3, 5), strict=True):
                        s[some] = np.add.reduceat(mix(items * np.uint64(2 * salt + 1) + np.uint64(salt)), edges[:-1][some])
                    keys, sketch = band_keys(items, edges), odd_sketches(items, edges)
                lists = [pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum((n > 0) * w)), pa.int32()), pa.array(x.reshape(-1).view(np.int64))) for x, w in ((keys, BANDS), (sketch, SKETCH_WORDS))]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(row, stop - row), texts.slice(row, stop - row), pa.array(n.astype(np.int64)), *(pa.array(s.view(np.int64)) for s in sums), *lists],
                    names=["doc_id", "row", "n_shingles", "s1", "s2", "keys", "sketch"],
                )

    kind = df.schema[id_col].dataType.simpleString()
    source = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("row"))
    return source.mapInArrow(run, f"doc_id {kind}, row long, n_shingles long, s1 long, s2 long, keys array<long>, sketch array<long>")


def numbered_shingles(data: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Document and number of each distinct shingle of each document; equal numbers mean equal words, compared whole."""
    data = LOWER[data]
    starts, ends, doc = words(data, offs)
    strings, word = distinct_spans(data, starts, ends)
    word, none = word.astype(np.int64), len(strings)  # a number that stands for no word
    size = np.bincount(doc, minlength=len(offs) - 1)
    grams = np.where(size >= k, size - k + 1, (size > 0).astype(np.int64))
    own = np.repeat(np.arange(len(size)), grams)
    at = np.arange(len(own)) - np.repeat(np.cumsum(grams) - grams, grams) + np.repeat(np.cumsum(size) - size, grams)
    end = np.repeat(np.cumsum(size), grams)
    number, span = word[at], none + 1
    for j in range(1, k):
        if span * (none + 1) >= 1 << 62:
            kinds, number = np.unique(number, return_inverse=True)
            span = len(kinds)
        number = number * (none + 1) + np.where(at + j < end, word[np.minimum(at + j, len(word) - 1)], none)
        span *= none + 1
    kinds, number = np.unique(number, return_inverse=True)
    both = np.unique(own * max(1, len(kinds)) + number)
    return both // max(1, len(kinds)), both % max(1, len(kinds))


def common_shingles(a: pa.Array, b: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the intersection and of the union of the sets of a[i] and b[i]."""
    m = len(a)
    _, _, data, offs = next(text_slices(pa.concat_arrays([a, b]), 1 << 62))
    doc, number = numbered_shingles(data, offs, k)
    size = np.bincount(doc, minlength=2 * m)
    order = np.lexsort((number, doc % m))
    pair, number = doc[order] % m, number[order]
    twice = (pair[1:] == pair[:-1]) & (number[1:] == number[:-1])
    common = np.bincount(pair[1:][twice], minlength=m)
    return common, size[:m] + size[m:] - common


PAIR_BYTES = 1 << 21


def _verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int, hubs: DataFrame) -> DataFrame:
    """a, b of the pairs (a, ra, b, rb) whose full sets have 100 * intersection >= percent * union; hubs: how many pairs each (b, rb) has."""
    both = salted_join(pairs, texts.toDF("b", "rb", "text_b"), ["b", "rb"], ["a", "ra"], hubs)
    both = both.join(texts.toDF("a", "ra", "text_a"), ["a", "ra"]).select("a", "b", "text_a", "text_b")

    def run(batches):
        only(("neardup",))
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            upto = np.cumsum(pc.add(pc.binary_length(x), pc.binary_length(y)).to_numpy(zero_copy_only=False), dtype=np.int64)
            at = 0
            while at < len(batch):
                stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIR_BYTES, "right")))
                common, union = common_shingles(x.slice(at, stop - at), y.slice(at, stop - at), k)
                keep = pa.array(100 * common >= percent * union)
                yield pa.RecordBatch.from_arrays([c.slice(at, stop - at).filter(keep) for c in batch.columns[:2]], names=["a", "b"])
                at = stop
            trim()

    return both.mapInArrow(run, "a long, b long")


def _set_rows(texts: DataFrame, k: int) -> DataFrame:
    """v, row, c, n, items of texts (v, row, c, text): the shingle hashes of each."""

    def run(batches):
        only(("neardup",))
        for batch in batches:
            for row, stop, data, offs in text_slices(batch.column(3)):
                items, edges = shingle_sets(data, offs, k)
                lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(items.view(np.int64)))
                yield pa.RecordBatch.from_arrays([*(c.slice(row, stop - row) for c in batch.columns[:3]), pa.array(np.diff(edges)), lists], names=["v", "row", "c", "n", "items"])

    return texts.select("v", "row", "c", "text").mapInArrow(run, "v long, row long, c long, n long, items array<long>")


def prefix_pairs(sets: DataFrame, percent: int) -> DataFrame:
    """a, ra, b, rb of pairs of sets (v, row, c, n, items) with different c; none that is similar enough is missing.

    With the items of each set in one order, rarest first, the first common one of a pair stands at
    places i and j (from 0) such that n - i and m - j are both at least the required overlap, percent
    * (n + m) / (100 + percent). So an item at place i can only serve partners of at most ``most`` items.
    """
    item = sets.select("v", "row", F.explode("items").alias("item"))
    shared = item.groupBy("item").agg(F.count("*").alias("f")).where("f > 1")
    ranked = item.join(shared, "item").groupBy("v", "row").agg(F.array_sort(F.collect_list(F.struct("f", "item"))).alias("s"))
    n, least = F.col("n"), F.ceil(percent * F.col("n") / 100)
    before = n - F.size("s")  # items of one set alone are the rarest
    reach = n - F.ceil(percent * (n + least) / (100 + percent)) + 1
    front = sets.select("v", "row", "c", "n").join(ranked, ["v", "row"]).select(
        "v", "row", "c", "n", least.alias("least"), before.alias("before"), F.posexplode(F.slice("s", F.lit(1), F.greatest(F.lit(0), reach - before).cast("int"))).alias("nth", "x")
    )
    most = F.floor((100 + percent) * (n - F.col("before") - F.col("nth")) / percent) - n
    level = lambda size: F.floor(F.log2(size) * 16).cast("int")
    served = F.sequence(level(F.col("least")), level(F.least("most", F.floor(100 * n / percent))))
    rows = front.select("v", "row", "c", "n", "least", most.alias("most"), F.col("x.item").alias("item")).where("most >= least")
    rows = rows.select("v", "row", "c", "n", "most", "item", level(n).alias("own"), F.explode(served).alias("other"))
    rows = rows.select("v", "row", "c", "n", "most", "item", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    left = rows.where("own = lo").drop("own").toDF("a", "ra", "ca", "na", "ma", "item", "lo", "hi")
    right = rows.where("own = hi").drop("own").toDF("b", "rb", "cb", "nb", "mb", "item", "lo", "hi")
    met = left.join(right, ["item", "lo", "hi"]).where("ca <> cb AND nb <= ma AND na <= mb AND (lo < hi OR a < b)")
    return met.select("a", "ra", "b", "rb").distinct()


def components(edges: DataFrame) -> DataFrame:
    """v, c: the smallest vertex that each vertex of ``edges`` (a, b) reaches.

    Labels take the least label of their neighbours and then jump to their label's label, until
    none changes; each round is written to the shared folder.
    """
    both = staged(edges.select("a", "b").union(edges.select("b", "a")).toDF("u", "v").where("u <> v").distinct(), "edges")
    labels = staged(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("c")).select(F.col("u").alias("v"), "c"), "labels")
    while True:
        near = both.join(labels, "v").groupBy("u").agg(F.min("c").alias("m")).select(F.col("u").alias("v"), "m")
        low = labels.join(near, "v").select("v", "c", F.least("c", "m").alias("d"))
        jump = labels.select(F.col("v").alias("d"), F.col("c").alias("e"))
        after = staged(low.join(jump, "d").select("v", F.least("d", "e").alias("c"), (F.least("d", "e") < F.col("c")).alias("changed")), "labels")
        discard(labels)
        labels = after.select("v", "c")
        labels._staged_path = after._staged_path
        if after.where("changed").isEmpty():
            discard(both)
            return labels


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    ensure_importable(df.sparkSession)
    rows = staged(sketch_rows(df, id_col, text_col, shingle_words), "sketches")
    kind = rows.schema["doc_id"].dataType
    full = rows.where("doc_id IS NOT NULL AND n_shingles > 0").withColumn("doc_id", F.col("doc_id").cast("long"))
    equal = ["s1", "s2", "n_shingles"]
    classes = staged(full.groupBy(*equal).agg(F.min(F.struct("doc_id", "row")).alias("rep"), F.count("*").alias("n")), "classes")
    member = salted_join(full.select("doc_id", "row", *equal), classes, equal, ["doc_id", "row"]).select("doc_id", F.col("rep.doc_id").alias("rep"))
    reps = full.join(classes.select(*equal, F.col("rep.doc_id").alias("doc_id"), F.col("rep.row").alias("row")), [*equal, "doc_id", "row"]).withColumnRenamed("doc_id", "v")
    banded = reps.select(F.struct("v", "row").alias("m"), F.posexplode("keys").alias("band", "key"))
    buckets = banded.groupBy("key").agg(F.min("m").alias("hub"), F.max("m").alias("top")).where("hub < top").select("key", "hub")
    crowd = staged(banded.join(buckets, "key").select("key", "m.*", F.when(F.col("band") < STAR_BANDS, F.col("hub")).alias("hub")), "crowd")
    texts = staged(
        df.select(F.col(id_col).cast("long").alias("v"), F.xxhash64(text_col).alias("row"), F.col(text_col).alias("text"))
        .join(crowd.select("v", "row").distinct(), ["v", "row"], "left_semi").groupBy("v", "row").agg(F.max("text").alias("text")),
        "texts",
    )
    alike = _alike(percent)
    sketch = reps.select("v", "row", "sketch", "n_shingles").join(texts.select("v", "row"), ["v", "row"], "left_semi")

    def similar(pairs: DataFrame, hubs: DataFrame) -> DataFrame:
        """a, b of the pairs that are verified, of those whose sketches and set sizes leave it possible."""
        x, y = sketch.toDF("a", "ra", "sa", "na"), sketch.toDF("b", "rb", "sb", "nb")
        sifted = salted_join(pairs.join(x, ["a", "ra"]), y, ["b", "rb"], ["a", "ra"], hubs).where(alike).select("a", "ra", "b", "rb")
        return _verified(sifted, texts, shingle_words, percent, hubs)

    per_hub = lambda pairs: staged(pairs.groupBy("b", "rb").agg(F.count("*").alias("n")), "hubs")
    stars = crowd.where("hub.v <> v OR hub.row <> row").select(F.col("v").alias("a"), F.col("row").alias("ra"), F.col("hub.v").alias("b"), F.col("hub.row").alias("rb")).distinct()
    stars = staged(stars, "stars")
    hubs = per_hub(stars)
    # Rows that share an id bring the classes of their texts together.
    several = member.groupBy("doc_id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi").select("doc_id", F.col("lo").alias("b"))
    same = member.join(several, "doc_id").select(F.col("rep").alias("a"), "b").where("a <> b")
    links = staged(similar(stars, hubs).union(same), "links")
    discard(stars, hubs)
    labels = components(links)

    placed = crowd.select("key", "v", "row").join(labels, "v", "left").select("key", "v", "row", F.coalesce("c", "v").alias("c"))
    mixed = placed.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("key")
    apart = placed.join(mixed, "key").select("v", "row", "c").distinct()
    sets = staged(_set_rows(texts.join(apart, ["v", "row"]), shingle_words), "sets")
    met = staged(prefix_pairs(sets, percent), "met")
    hubs = per_hub(met)
    discard(crowd, sets)
    more = staged(similar(met, hubs), "links")
    discard(texts, met, hubs)
    if not more.isEmpty():
        discard(labels)
        labels = components(links.union(more))
    discard(links, more)
    groups = member.join(labels.withColumnRenamed("v", "rep"), "rep", "left").groupBy("doc_id").agg(F.min(F.coalesce("c", "rep")).alias("component_id"))
    out = rows.select("doc_id", "n_shingles").join(groups.withColumn("doc_id", F.col("doc_id").cast(kind)), "doc_id", "left")
    component = F.coalesce(F.col("component_id").cast(kind), F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _alike(percent: int):
    """Whether sizes and sketches of a pair leave the similarity possible."""
    ones = F.bit_count(F.col("sa")[0].bitwiseXOR(F.col("sb")[0]))
    for k in range(1, SKETCH_WORDS):
        ones = ones + F.bit_count(F.col("sa")[k].bitwiseXOR(F.col("sb")[k]))
    step = F.floor(F.log2(F.col("na") + F.col("nb")) * STEPS_AN_OCTAVE).cast("int")
    bound = F.element_at(F.lit(sketch_bounds(percent / 100)), step + 1)
    return (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent) & (ones <= bound)
