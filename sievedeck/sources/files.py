"""Sources and sinks: CSV, text and HTML folders, zip archives, page fetches by a given function."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Strings that a CSV cell may hold for a missing value.
NULL_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


def read_csv(spark: SparkSession, path: str, schema: str, null_tokens: list[str] = NULL_TOKENS) -> DataFrame:
    """A headed CSV with quoted line breaks; string cells that say missing are null."""
    df = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return df.select(*(F.when(~F.col(c).isin(null_tokens), F.col(c)).alias(c) if kind == "string" else F.col(c) for c, kind in df.dtypes))


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of headed CSV parts that read_csv reads back."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').option("quoteAll", True).csv(path)


def _sound(value: Column) -> Column:
    """UTF-8 without its broken bytes."""
    return F.replace(F.make_valid_utf8(value), F.lit("�"), F.lit(""))


def read_folder(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """filename, text of the files of a folder (of one suffix)."""
    df = spark.read.option("wholetext", True).option("pathGlobFilter", f"*{suffix}").text(path)
    return df.select(F.col("_metadata.file_name").alias("filename"), _sound(F.col("value")).alias("text"))


def write_folder(df: DataFrame, path: str, name_col: str = "filename", text_col: str = "text") -> None:
    """A folder a name, each with the text; read back with read_named.

    For fixtures and reports: a file a document burdens any file system when there are millions of them.
    """
    df.select(F.col(name_col).alias("name"), F.col(text_col).alias("text")).write.mode("overwrite").partitionBy("name").option("lineSep", "\0").text(path)


def read_named(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.option("basePath", path).option("lineSep", "\0").text(f"{path}/*")
    return df.select(F.col("name").cast("string").alias("filename"), F.col("value").alias("text"))


def read_zip(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """archive, filename, text of the members of zip archives; an archive is one task's work."""

    def run(batches):
        import io
        import zipfile

        import pandas as pd

        for batch in batches:
            for archive, content in zip(batch["path"], batch["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for m in z.infolist():
                        if not m.is_dir() and m.filename.endswith(suffix):
                            yield pd.DataFrame({"archive": [archive], "filename": [m.filename], "text": [z.read(m).decode("utf-8", "ignore")]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "archive string, filename string, text string")


# The two agents that the cloaking check asks as.
NORMAL_AGENT, BOT_AGENT = "Mozilla/5.0", "Googlebot"


def http_get(agent: str | None = None, timeout: float = 10) -> Callable[[str], str]:
    """A function that reads a page: seconds to wait, the agent to name, the status not checked, text by the declared charset."""

    def get(url: str) -> str:
        from urllib.error import HTTPError
        from urllib.request import Request, urlopen

        try:
            answer = urlopen(Request(url, headers={"User-Agent": agent} if agent else {}), timeout=timeout)  # noqa: S310
        except HTTPError as refused:  # a page of its own
            answer = refused
        with answer:
            return answer.read().decode(answer.headers.get_content_charset() or "utf-8", "replace")

    return get


def fetch_pages(urls: DataFrame, fetch: Callable[[str], str] | None = None, url_col: str = "url") -> DataFrame:
    """url, html, error: what the function (``http_get()`` by default) returns for each url, or its exception as data."""
    fetch = fetch or http_get()

    def run(batches):
        import pandas as pd

        for batch in batches:
            rows = []
            for url in batch[url_col]:
                try:
                    rows.append((url, fetch(url), None))
                except Exception as e:  # a failed page is a row
                    rows.append((url, None, str(e)))
            yield pd.DataFrame(rows, columns=["url", "html", "error"])

    return urls.select(url_col).mapInPandas(run, "url string, html string, error string")


def fetch_twice(urls: DataFrame, normal: Callable[[str], str] | None = None, bot: Callable[[str], str] | None = None, url_col: str = "url") -> tuple[DataFrame, DataFrame]:
    """url, body, error of two snapshots, asked for as a browser and as a search engine; each is fetched when it is read."""
    agents = (normal or http_get(NORMAL_AGENT), bot or http_get(BOT_AGENT))
    return tuple(fetch_pages(urls, f, url_col).withColumnRenamed("html", "body") for f in agents)


def union_records(*tables: DataFrame) -> DataFrame:
    """Records of different columns under one another, by name; what a record lacks is null."""
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table, allowMissingColumns=True)
    return out
