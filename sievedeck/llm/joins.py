"""Joins on keys of which a few may have a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT, SALTS = 1000, 64


def salted_join(rows: DataFrame, index: DataFrame, keys: list[str], spread: list[str], counts: DataFrame | None = None) -> DataFrame:
    """``rows`` joined with ``index`` (a row a key) on ``keys``, whole.

    ``counts`` (``index`` itself unless given) has ``n``, the rows of each key, and is staged. Keys with more
    than a ``HOT``-th of all rows, of which there are fewer than ``HOT`` whatever
    the corpus, are marked by a broadcast; their rows are dealt by a hash of the columns
    ``spread`` over ``SALTS`` tasks, each of which has a copy of the index row.
    """
    counts = index if counts is None else counts
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = counts.where(F.col("n") * HOT > total).select(*keys, F.lit(True).alias("__hot"))
    salt = F.when(F.col("__hot"), F.pmod(F.xxhash64(*spread), F.lit(SALTS))).otherwise(F.lit(0).cast("long"))
    copies = F.when(F.col("__hot"), F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    dealt = rows.join(F.broadcast(hot), keys, "left").withColumn("__salt", salt).drop("__hot")
    copied = index.join(F.broadcast(hot), keys, "left").withColumn("__salt", F.explode(copies)).drop("__hot")
    return dealt.join(copied, [*keys, "__salt"]).drop("__salt")
