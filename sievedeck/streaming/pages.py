"""Web pages that arrive as files: profiles row by row, statistics by windows of time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievedeck.operators.pages import hrefs, is_dynamic, text_length


def read_pages(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of the Parquet files of a folder as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def profile_stream(pages: DataFrame, key: str = "url", html_col: str = "html", time_col: str = "fetched") -> DataFrame:
    """url, the time, text_length, outgoing_links and is_dynamic of each page of a stream; no state is kept."""
    html = F.col(html_col)
    outgoing = F.size(F.filter(hrefs(html), lambda h: F.startswith(h, F.lit("http")))).cast("long")
    return pages.select(F.col(key).alias("url"), F.col(time_col), text_length(html).alias("text_length"), outgoing.alias("outgoing_links"), is_dynamic(html).alias("is_dynamic"))


def profile_windows(profiles: DataFrame, time_col: str = "fetched", width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Start of each window, pages, mean text length and outgoing links; later than ``delay``, rows no longer count and the state goes."""
    by = profiles.withWatermark(time_col, delay).groupBy(F.window(time_col, width).alias("w"))
    made = by.agg(F.count("*").alias("pages"), F.avg("text_length").alias("avg_text_length"), F.avg("outgoing_links").alias("avg_outgoing_links"))
    return made.select(F.col("w.start").alias("start"), "pages", "avg_text_length", "avg_outgoing_links")
