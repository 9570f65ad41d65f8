"""Web pages: profiles, statistics, features, clusters; keyword stuffing and cloaking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievedeck.functions.text import strip, tokens
from sievedeck.operators.index import spread

# A tag's inside: quoted values may hold ">". Possessive, so that broken mark-up costs no backtracking.
INSIDE = r"""(?:"[^"]*+"|'[^']*+'|[^'">]++)*+"""
HIDDEN = rf"(?is)<(script|style)\b{INSIDE}>.*?(?:</\1\s*>|\z)|<!--.*?(?:-->|\z)|<[!?][^>]*>"
TAG = rf"(?s)</?[a-zA-Z]{INSIDE}>"
LINK = rf"(?is)<a\s{INSIDE}>"
ATTRIBUTE = r"""(?is)^<a\s(?:[^"'>]*?(?:"[^"]*+"|'[^']*+'))*?[^"'>]*?(?<![^\s"'/])href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
SOURCE = rf"""(?is)<script(?=[\s/])(?:[^"'>]*?(?:"[^"]*+"|'[^']*+'))*?[^"'>]*?(?<![^\s"'/])src\s*="""


def _entity_table() -> str:
    """The named entities, from the standard library, as JSON; with ";" and, for those that may lack it, without."""
    import json
    from html.entities import html5

    return json.dumps(html5)


def _legacy_names() -> str:
    """A pattern of the names that need no ";", longest first."""
    from html.entities import html5

    return "|".join(sorted((name for name in html5 if not name.endswith(";")), key=len, reverse=True))


def _code_point(number: Column) -> Column:
    """The character of a numeric reference: Windows-1252 from 128 to 159, nothing for controls and non-characters."""
    windows = {n: bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(128, 160)}
    table = F.from_json(F.lit(__import__("json").dumps({str(n): c for n, c in windows.items()})), "map<string,string>")
    plain = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    control = number.between(1, 8) | number.between(14, 31) | (number == 11) | (number == 127) | number.between(0xFDD0, 0xFDEF) | (F.pmod(number, F.lit(65536)) >= 65534)
    return (
        F.when(number.isNull() | (number == 0) | (number > 0x10FFFF) | number.between(0xD800, 0xDFFF), "�")
        .when(number.between(128, 159), F.element_at(table, number.cast("string"))).when(control, "").otherwise(plain)
    )


def decode_entities(text: Column) -> Column:
    """Character references, named and numeric, as browsers read them; other ampersands stay.

    Most texts have the five of mark-up only, or none, and take the short ways.
    """
    table, legacy = F.from_json(F.lit(_entity_table()), "map<string,string>"), _legacy_names()

    def one(part: Column) -> Column:
        name = F.regexp_extract(part, r"^(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;)", 1)
        number = F.regexp_extract(name, r"^#0*([0-9]{1,9});?$", 1)
        hexadecimal = F.regexp_extract(name, r"^#[xX]0*([0-9a-fA-F]{1,8});?$", 1)
        # Longer numbers are beyond all code points; a reference of zeros alone is number 0.
        value = F.when(number != "", number.cast("long")).when(hexadecimal != "", F.conv(hexadecimal, 16, 10).cast("long")).when(name.rlike("^#[xX]?0+;?$"), F.lit(0).cast("long"))
        known = F.element_at(table, name)
        old = F.regexp_extract(part, f"^({legacy})", 1)
        rest = lambda used: F.substr(part, F.char_length(used) + 1)
        return (
            F.when(F.startswith(name, F.lit("#")), F.concat(_code_point(value), rest(name)))
            .when((name != "") & known.isNotNull(), F.concat(known, rest(name)))
            .when(old != "", F.concat(F.element_at(table, old), rest(old)))
            .otherwise(F.concat(F.lit("&"), part))
        )

    parts = F.split(text, "&")
    whole = F.concat(F.element_at(parts, 1), F.array_join(F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), one), ""))
    short = text
    for name, value in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("nbsp", " "), ("amp", "&")):
        short = F.replace(short, F.lit(f"&{name};"), F.lit(value))
    return F.when(~F.contains(text, F.lit("&")), text).when(~text.rlike("&(?!(?:lt|gt|quot|nbsp|amp);)[#a-zA-Z]"), short).otherwise(whole)


def text_length(html: Column) -> Column:
    """Characters of the stripped text nodes; scripts, styles and comments are no text."""
    nodes = F.split(F.regexp_replace(html, HIDDEN, "<x>"), TAG)
    return F.aggregate(nodes, F.lit(0).cast("long"), lambda n, node: n + F.char_length(strip(decode_entities(node))))


def page_text(html: Column) -> Column:
    """Text with a space for each tag."""
    return decode_entities(F.regexp_replace(F.regexp_replace(html, HIDDEN, "<x>"), TAG, " "))


def hrefs(html: Column) -> Column:
    """Targets of the links that have one, quoted either way or not at all."""
    tags = F.filter(F.regexp_extract_all(F.regexp_replace(html, HIDDEN, "<x>"), F.lit(LINK), F.lit(0)), lambda tag: tag.rlike(ATTRIBUTE))
    return F.transform(tags, lambda tag: decode_entities(F.concat(*(F.regexp_extract(tag, ATTRIBUTE, k) for k in (1, 2, 3)))))


def is_dynamic(html: Column) -> Column:
    return F.contains(F.lower(html), F.lit("ajax")) | F.regexp_replace(html, r"(?s)<!--.*?(?:-->|\z)", "").rlike(SOURCE)


def page_profile(pages: DataFrame, key: str = "url", html_col: str = "html", error_col: str | None = None) -> DataFrame:
    """url, text_length, outgoing_links (http...), total_links, is_dynamic, error; failed pages have only an error."""
    html = F.col(html_col)
    error = F.col(error_col) if error_col else F.lit(None).cast("string")
    links = hrefs(html)
    return spread(pages, key).select(
        F.col(key).alias("url"), text_length(html).alias("text_length"), F.size(F.filter(links, lambda h: F.startswith(h, F.lit("http")))).cast("long").alias("outgoing_links"),
        F.size(links).cast("long").alias("total_links"), is_dynamic(html).alias("is_dynamic"), error.alias("error"),
    )


def profile_stats(profile: DataFrame) -> DataFrame:
    """Mean, least and greatest text length and outgoing links; nulls are skipped, and nothing gives nulls."""
    return profile.agg(*(f(c).alias(f"{name}_{c}") for c in ("text_length", "outgoing_links") for name, f in (("avg", F.avg), ("min", F.min), ("max", F.max))))


def word_modes(df: DataFrame, key: str, words: Column) -> DataFrame:
    """key, word, freq, total: the most frequent word (of equals the first in the text) and the number of words."""
    rows = spread(df.select(F.col(key).alias("key"), words.alias("ws")), "key").select("key", F.posexplode("ws").alias("pos", "word"))
    counted = rows.groupBy("key", "word").agg(F.count("*").alias("freq"), F.min("pos").alias("first"))
    best = counted.groupBy("key").agg(F.max_by(F.struct("word", "freq"), F.struct(F.col("freq"), -F.col("first"))).alias("m"), F.sum("freq").alias("total"))
    return best.select(F.col("key").alias(key), "m.word", "m.freq", "total")


def page_features(pages: DataFrame, key: str = "page_id", html_col: str = "html") -> DataFrame:
    """key, word_count, mode_freq, http_links ('http' anywhere in the target)."""
    html = F.col(html_col)
    modes = word_modes(pages, key, tokens(page_text(html)))
    links = pages.select(key, F.size(F.filter(hrefs(html), lambda h: F.contains(h, F.lit("http")))).cast("long").alias("http_links"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return links.join(modes, key, "left").select(key, zero("total").alias("word_count"), zero("freq").alias("mode_freq"), "http_links")


def keyword_stuffing(df: DataFrame, key: str = "doc_id", text_col: str = "text", threshold: float = 0.15) -> DataFrame:
    """key, word, freq, total, ratio, stuffed, report; texts without words say so."""
    modes = word_modes(df.where(F.col(text_col).isNotNull()), key, tokens(F.col(text_col)))
    ratio = F.col("freq").cast("double") / F.col("total")
    report = F.when(F.col("word").isNull(), "no words").otherwise(F.format_string("%s: %d of %d words, ratio %.2f, %s", "word", "freq", "total", ratio, F.when(ratio > threshold, "stuffed").otherwise("not stuffed")))
    joined = df.select(key).join(modes, key, "left")
    return joined.select(key, "word", F.coalesce("freq", F.lit(0).cast("long")).alias("freq"), F.coalesce("total", F.lit(0).cast("long")).alias("total"), ratio.alias("ratio"), F.coalesce(ratio > threshold, F.lit(False)).alias("stuffed"), report.alias("report"))


def two_decimals(x: Column) -> Column:
    """A number of 0 or more as C's printf writes it with %.2f: its binary value rounded, ties to even.

    Java's formatter rounds the shortest decimal form instead, ties up (18.125 to 18.13). All steps are exact:
    a part of 2^-4 or more is a multiple of 2^-56, one of 2^-8 or more of 2^-60, and a lesser one rounds to 0.
    """
    whole = F.floor(x).cast("long")
    part = x - whole
    small = part < 2.0**-4
    hundredths = F.when(small, part * 2.0**60).otherwise(part * 2.0**56).cast("long") * 100
    down = F.when(small, F.shiftright(hundredths, 60)).otherwise(F.shiftright(hundredths, 56))
    rest = hundredths - F.when(small, F.shiftleft(down, 60)).otherwise(F.shiftleft(down, 56))
    half = F.when(small, F.lit(1 << 59)).otherwise(F.lit(1 << 55))
    total = whole * 100 + down + ((rest > half) | ((rest == half) & (down % 2 == 1))).cast("long")
    return F.concat(F.floor(total / 100).cast("string"), F.lit("."), F.lpad((total % 100).cast("string"), 2, "0"))


def compare_snapshots(both: DataFrame, key: str = "url", normal_col: str = "x", bot_col: str = "y", threshold: float = 0.10, preview: int = 500) -> DataFrame:
    """The columns of ``cloaking_check`` for each row of a table that has both stripped responses; keys may repeat."""
    both = both.select(key, F.col(normal_col).alias("x"), F.col(bot_col).alias("y"))
    both = both.select("*", F.char_length("x").alias("n"), F.char_length("y").alias("m"))
    both = both.select("*", F.try_divide(F.abs(F.col("n") - F.col("m")).cast("double"), "n").alias("ratio"))
    ratio = F.col("ratio")
    status = F.when(F.col("x").isNull() | F.col("y").isNull(), "error").when(F.col("n") == 0, "empty_normal").otherwise("ok")
    found = F.when(ratio > threshold, f"more than {threshold:.0%} apart, which may be cloaking").otherwise("no large difference")
    report = (
        F.when(status == "error", "a response is missing").when(status == "empty_normal", "the normal response is empty")
        .otherwise(F.concat_ws("\n", F.format_string("normal response: %d characters", "n"), F.format_string("response for bots: %d characters", "m"), F.concat(F.lit("difference: "), two_decimals(ratio * 100), F.lit("%")), found))
    )
    return both.select(
        key, status.alias("status"), F.col("n").cast("long").alias("len_normal"), F.col("m").cast("long").alias("len_bot"), ratio, F.coalesce(ratio > threshold, F.lit(False)).alias("suspicious"),
        F.substring("x", 1, preview).alias("normal_preview"), F.substring("y", 1, preview).alias("bot_preview"), report.alias("report"),
    )


def cloaking_check(normal: DataFrame, bot: DataFrame, key: str = "url", body_col: str = "body", threshold: float = 0.10, preview: int = 500) -> DataFrame:
    """key, status (ok, error, empty_normal), lengths, ratio, suspicious, previews, report, from two snapshots of each page.

    A key stands once in a snapshot; where both responses are in one row, ``compare_snapshots`` needs no join.
    """
    a = normal.select(key, strip(F.col(body_col)).alias("x"))
    b = bot.select(key, strip(F.col(body_col)).alias("y"))
    return compare_snapshots(a.join(b, key, "full"), key, threshold=threshold, preview=preview)


def cluster_pages(features: DataFrame, columns: list[str], k: int = 2, seed: int = 42, starts: int = 5) -> DataFrame:
    """Add cluster by k-means on the columns as they are, of several starts that of least cost; clusters are numbered by the mean of the first column."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    ready = VectorAssembler(inputCols=columns, outputCol="__v").transform(features)
    models = [KMeans(k=k, seed=seed + n, maxIter=50, tol=0.0, featuresCol="__v", predictionCol="__p").fit(ready) for n in range(starts)]
    model = min(models, key=lambda m: m.summary.trainingCost)
    order = sorted(range(len(model.clusterCenters())), key=lambda i: tuple(model.clusterCenters()[i]))
    number = F.element_at(F.lit([order.index(i) for i in range(len(order))]), F.col("__p") + 1)
    return model.transform(ready).withColumn("cluster", number).drop("__v", "__p")


def lloyd(df: DataFrame, columns: list[str], iterations: int = 8) -> DataFrame:
    """Add cluster (0 or 1) by Lloyd iterations from the columns' least and greatest values; ties go to 0.

    Centres are two rows of fixed width, so each iteration is one pass and one broadcast of a row.
    """
    first = df.agg(*(F.min(c).cast("double").alias(f"a_{c}") for c in columns), *(F.max(c).cast("double").alias(f"b_{c}") for c in columns))

    def placed(centres: DataFrame) -> DataFrame:
        away = lambda side: sum(((F.col(c) - F.col(f"{side}_{c}")) * (F.col(c) - F.col(f"{side}_{c}")) for c in columns), F.lit(0.0))
        return df.crossJoin(F.broadcast(centres)).withColumn("cluster", F.when(away("b") < away("a"), 1).otherwise(0))

    centres = first
    for _ in range(iterations):
        own = placed(centres)
        row = own.agg(*(F.avg(F.when(F.col("cluster") == g, F.col(c))).alias(f"{s}_{c}") for g, s in ((0, "a"), (1, "b")) for c in columns)).collect()[0]
        centres = df.sparkSession.createDataFrame([row.asDict()], ", ".join(f"{s}_{c} double" for s in "ab" for c in columns))
    return placed(centres).drop(*(f"{s}_{c}" for s in "ab" for c in columns))
