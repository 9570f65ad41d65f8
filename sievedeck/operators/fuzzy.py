"""Fuzzy matching of candidate strings with a query."""

from __future__ import annotations

from difflib import SequenceMatcher

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievedeck.functions.text import WORD, char_grams, cosine, indel_ratio, jaccard
from sievedeck.session import ensure_importable


def kgram_jaccard(text: Column, other: str, k: int = 3) -> Column:
    """Similarity of the sets of k-character grams; null if both are empty."""
    return jaccard(char_grams(text, k), char_grams(F.lit(other), k))


def sequence_ratio(other: str):
    """A column function: Ratcliff-Obershelp ratio of a string (first) and the literal (second)."""

    @F.pandas_udf("double")
    def ratio(texts):
        import pandas as pd

        known = {t: SequenceMatcher(None, t, other).ratio() for t in texts.dropna().unique()}
        return pd.Series([known.get(t) for t in texts], dtype="float64")

    return ratio


def mean_vectors(df: DataFrame, key: str, text_col: str, vectors: DataFrame) -> DataFrame:
    """key, vector: the mean of the vectors (word, vector) of a text's words; words without one count for nothing."""
    rows = df.select(key, F.explode(F.regexp_extract_all(F.col(text_col), F.lit(WORD), F.lit(0))).alias("word")).join(vectors, "word")
    means = rows.select(key, F.posexplode("vector").alias("d", "x")).groupBy(key, "d").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("vector"))


def fuzzy_features(candidates: DataFrame, other: str, text_col: str = "category", vectors: DataFrame | None = None, difflib_sound: bool = True) -> DataFrame:
    """query, final_score, k_gram, noise, semantic, sound of each candidate, in the candidates' own order.

    noise is the negated Ratcliff-Obershelp ratio; sound an edit ratio in whole hundredths; semantic the cosine of mean
    word vectors, 0 without a vector table. The blend of a quarter each is made before rounding.
    """
    ensure_importable(candidates.sparkSession)
    text = F.col(text_col)
    df = candidates.withColumn("__k", F.coalesce(kgram_jaccard(text, other), F.lit(0.0))).withColumn("__r", sequence_ratio(other)(text))
    sound = F.bround(100 * (F.col("__r") if difflib_sound else indel_ratio(text, other)), 0) / 100
    semantic = F.lit(0.0)
    if vectors is not None:
        one = candidates.sparkSession.range(1).select(F.lit(other).alias("t"))
        own = mean_vectors(one, "t", "t", vectors).select(F.col("vector").alias("__q"))
        each = mean_vectors(candidates.select(text.alias("__t")).distinct(), "__t", "__t", vectors).withColumnRenamed("vector", "__v")
        df = df.join(each, text == F.col("__t"), "left").join(F.broadcast(own), F.lit(True), "left")
        semantic = F.coalesce(cosine(F.col("__v"), F.col("__q")), F.lit(0.0))
    parts = df.select(text.alias("query"), F.col("__k").alias("k_gram"), (-F.col("__r")).alias("noise"), semantic.alias("semantic"), sound.alias("sound"))
    final = 0.25 * (F.col("k_gram") + F.col("noise") + F.col("sound") + F.col("semantic"))
    return parts.select("query", F.round(final, 4).alias("final_score"), *(F.round(c, 4).alias(c) for c in ("k_gram", "noise", "semantic", "sound")))
