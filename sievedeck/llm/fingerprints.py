"""Canonical exact digests of documents, in SQL functions only.

The canonical text is Unicode-normalised (NFKC), case-folded, with runs of white space as one
space and none at the ends. Its digest is four xxhash64 lanes, 256 bits. Documents are
grouped by digest, and inside a group the least and greatest canonical text are compared byte
by byte; should they differ, the fingerprints of that digest get the texts' SHA-256 appended, so equal
fingerprints mean equal canonical texts.

Normalisation and folding are ICU's, which Spark ships for its collations,
called by the SQL function ``reflect``.

Defined results: null counts as empty; rows that share an id are rows of their own;
an empty table gives an empty result; other columns are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievedeck.llm.docorder import ordered_parts
from sievedeck.session import staged, unused

LANES = 4


def canonical(text: Column) -> Column:
    """NFKC, full case folding, NFKC again (folding can undo it), and white space as single spaces."""
    nfkc = lambda x: F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), x, F.lit(True))
    folded = F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), nfkc(F.coalesce(text, F.lit(""))), F.lit(True))
    return F.trim(F.regexp_replace(nfkc(folded), r"[\s\p{Z}\x{1C}-\x{1F}\x{85}]+", " "))


def digest(canon: Column) -> Column:
    """64 hex digits of four differently seeded xxhash64 lanes."""
    return F.lower(F.concat(*(F.lpad(F.hex(F.xxhash64(F.lit(k), canon)), 16, "0") for k in range(LANES))))


def mixed_digests(canon: DataFrame) -> DataFrame | None:
    """Digests (of columns canon, digest) under which texts differ; None if there are none.

    Minima and maxima merge copies before the shuffle, so a text that a third of all
    documents have is a row a task.
    """
    found = staged(canon.groupBy("digest").agg(F.min("canon").alias("lo"), F.max("canon").alias("hi")).where("lo <> hi").select("digest"), "digests")
    return None if found.isEmpty() else found


def _settle(df: DataFrame, digest_col: str, canon_col: str, mixed: DataFrame | None) -> DataFrame:
    """Replace a digest by the fingerprint."""
    if mixed is None:
        return df
    (name,) = unused(df, "__mixed")
    joined = df.join(mixed.select(F.col("digest").alias(name)), F.col(digest_col) == F.col(name), "left")
    made = F.when(F.col(name).isNull(), F.col(digest_col)).otherwise(F.concat(digest_col, F.lit("-"), F.sha2(F.col(canon_col), 256)))
    return joined.withColumn(digest_col, made).drop(name)


def with_fingerprint(df: DataFrame, text_col: str = "text", out_col: str = "fingerprint") -> DataFrame:
    """Add the fingerprint of each text."""
    (name,) = unused(df, "__canon")
    made = df.withColumn(name, canonical(F.col(text_col))).withColumn(out_col, digest(F.col(name)))
    return _settle(made, out_col, name, mixed_digests(made.select(F.col(name).alias("canon"), F.col(out_col).alias("digest")))).drop(name)


def likeness(a: Column, b: Column) -> Column:
    """Exact digests are alike wholly or not at all."""
    return F.when(a == b, 1.0).otherwise(0.0)


def next_texts(df: DataFrame, rows_per_bucket: int = 4096) -> DataFrame:
    """Add next_text and next_digest of the row after each by doc_id (after the last: the first); df: doc_id, text, digest.

    Rows are dealt by ranges of ids, so there is no global sort: a row's follower is in its own range,
    but for the last one's, which is the first row of the next range that has any.
    """
    bucket, parts = ordered_parts(df, "doc_id", rows_per_bucket, F.xxhash64("text"), 8)
    marked = df.withColumn("bucket", bucket)
    dealt = marked.repartition(parts, "bucket")  # the same exchange for the three uses below
    order = Window.partitionBy("bucket").orderBy("doc_id", "text")
    placed = dealt.select("*", F.lead("text").over(order).alias("next_text"), F.lead("digest").over(order).alias("next_digest"), F.lead(F.lit(1)).over(order).alias("more"), F.row_number().over(order).alias("nth"))
    inner = placed.where("more = 1")
    by_bucket = Window.orderBy("bucket")  # a row a range
    heads = placed.where("nth = 1").select("bucket", F.col("text").alias("head_text"), F.col("digest").alias("head_digest"))
    before = marked.select("bucket").distinct().select("bucket", F.lag("bucket").over(by_bucket).alias("b"), F.max("bucket").over(Window.partitionBy()).alias("top")).select("bucket", F.coalesce("b", "top").alias("last_of"))
    heads = heads.join(before, "bucket").select(F.col("last_of").alias("bucket"), "head_text", "head_digest")
    last = placed.where("more IS NULL").join(heads, "bucket").select(*df.columns, F.col("head_text").alias("next_text"), F.col("head_digest").alias("next_digest"))
    return inner.select(*df.columns, "next_text", "next_digest").unionByName(last)


def fingerprint_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited form, whose latter half is the next document's beginning."""
    doc_id = F.col(id_col) if id_col == "doc_id" else F.col(id_col).alias("doc_id")  # an alias to the same name would keep exchanges apart
    docs = df.select(doc_id, F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    made = docs.withColumn("canon", canonical(F.col("text"))).withColumn("digest", digest(F.col("canon")))
    mixed = mixed_digests(made.select("canon", "digest"))
    n, half = F.char_length("text"), F.floor(F.char_length("text") / 2).cast("int")
    rows = _settle(made, "digest", "canon", mixed).select("doc_id", "text", "digest")
    edited = (
        next_texts(rows).select("doc_id", n.cast("long").alias("n_chars"), "text", "digest", "next_digest", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)).alias("edited"))
        .withColumn("canon", canonical(F.col("edited"))).withColumn("edited_digest", digest(F.col("canon")))
    )
    # The bytes of a text and of its edited form are compared where their digests agree.
    other = (F.col("digest") == F.col("edited_digest")) & (canonical(F.col("text")) != F.col("canon"))
    edited = edited.withColumn("edited_digest", F.when(other, F.concat("edited_digest", F.lit("-"), F.sha2("canon", 256))).otherwise(F.col("edited_digest")))
    return _settle(edited, "edited_digest", "canon", mixed).select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.col("digest").alias("fingerprint"), F.col("edited_digest").alias("edited_fingerprint"),
        likeness(F.col("digest"), F.col("edited_digest")).alias("near_edited"), likeness(F.col("digest"), F.col("next_digest")).alias("near_next"),
    )
