"""Ranges of document ids as balanced buckets, without a global sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUANTILES, NULL_BUCKETS = 256, 64


def ordered_parts(df: DataFrame, id_col: str, rows_per_bucket: int, nulls: Column | None = None, per_part: int = 1, least: int = 96) -> tuple[Column, int]:
    """A bucket number that rises with ``id_col``, and the partitions to deal buckets over, about ``per_part`` in each.

    Null ids come first: bucket -1, or, by the hash ``nulls``, ``NULL_BUCKETS`` of them.

    The bounds are up to 256 approximate quantiles of the ids (one pass over that
    column, a result of fixed size), each range cut evenly into as many parts
    as the number of rows asks for. Unlike the bounds of a range exchange they are
    the same in every job, and nothing but the id column is read twice.
    """
    shares = [k / QUANTILES for k in range(1, QUANTILES)]
    row = df.agg(F.count(id_col).alias("n"), F.min(id_col).alias("lo"), F.max(id_col).alias("hi"), F.percentile_approx(id_col, shares, 10_000).alias("q")).first()
    none = F.lit(-1).cast("long") if nulls is None else -1 - F.pmod(nulls, F.lit(NULL_BUCKETS)).cast("long")
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if not row["n"]:
        return none, usual
    wanted = max(least, row["n"] // rows_per_bucket)
    bounds = sorted({row["lo"], *row["q"]})
    parts = max(1, -(-wanted // len(bounds)))
    low = F.lit([float(x) for x in bounds])
    high = F.lit([*(float(x) for x in bounds[1:]), float(row["hi"]) + 1])
    k = F.size(F.filter(F.lit(bounds).cast("array<long>"), lambda x: x <= F.col(id_col)))
    a, b = F.element_at(low, k), F.element_at(high, k)
    inner = F.least(F.lit(parts - 1), F.floor((F.col(id_col).cast("double") - a) / F.greatest(b - a, F.lit(1.0)) * parts))
    # Never null to the optimiser either, so that joins on it put no filter between uses of one exchange.
    bucket = F.coalesce(F.when(F.col(id_col).isNull(), none).otherwise((k - 1) * parts + inner).cast("long"), F.lit(-1).cast("long"))
    return bucket, max(usual, wanted // per_part)


def order_buckets(df: DataFrame, id_col: str, rows_per_bucket: int, least: int = 96) -> Column:
    """The bucket number alone; null ids have bucket -1."""
    return ordered_parts(df, id_col, rows_per_bucket, least=least)[0]
