"""The opN_ queries: each applies its operator to a whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievedeck.llm import bpe, fingerprints, jpeg, licences, lines, neardup, packing, substrings, tokenstore, toxicity
from sievedeck.session import small_batches


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_report(_documents(spark, sf_dir))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), added_tokens=True)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.substring_dedup(_documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "dedup.n_words", "dedup.n_removed", "dedup.kept_sha256")


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenstore.write_token_store(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), added_tokens=True).statistics()


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = lines.line_dedup(_documents(spark, sf_dir).select("doc_id", "text"), passages=True)
    return made.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = toxicity.fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    scored = toxicity.score_toxicity(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_documents(spark, sf_dir), shingle_words=4, percent=80)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_round_trip(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.licence_scan(_documents(spark, sf_dir))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg.media_features(jpeg.with_media(_documents(spark, sf_dir).select("doc_id", "text")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


#: A word is repeated if one of the last 20 windows that start at or before it has an earlier start of the same words.
SUBSTRINGS = r"""WITH t AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM t),
win AS (SELECT doc_id, generate_subscripts(x, 1) AS p, unnest(x) AS said FROM (SELECT doc_id, list_transform(range(1, len(ws) - 18), lambda i: array_to_string(ws[i:i + 19], ' ')) AS x FROM t)),
nth AS (SELECT doc_id, p, row_number() OVER (PARTITION BY said ORDER BY doc_id, p) AS n FROM win),
c AS (SELECT w.doc_id, word, w.p, coalesce(w.p - max(CASE WHEN n > 1 THEN nth.p END) OVER (PARTITION BY w.doc_id ORDER BY w.p) <= 19, false) AS gone FROM w LEFT JOIN nth ON nth.doc_id = w.doc_id AND nth.p = w.p),
k AS (SELECT doc_id, count(*) AS n_words, count_if(gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY p) FILTER (NOT gone), '') AS kept FROM c GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM t LEFT JOIN k USING (doc_id)"""

NEAR_DUPLICATES = r"""WITH RECURSIVE t AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS gram FROM t),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y ON x.gram = y.gram AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS v, doc_id AS r FROM t UNION SELECT v, b FROM reach JOIN both_ways ON a = r),
comp AS (SELECT v, min(r) AS c FROM reach GROUP BY v)
SELECT t.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c AS component_id, t.doc_id = c AS kept FROM t JOIN comp ON v = t.doc_id LEFT JOIN n ON n.doc_id = t.doc_id"""

#: A line is repeated if it and the line after or before it also stand together earlier.
LINES = r"""WITH t AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS p FROM t),
two AS (SELECT doc_id, p, line, lead(line) OVER (PARTITION BY doc_id ORDER BY p) AS following FROM l),
nth AS (SELECT doc_id, p, row_number() OVER (PARTITION BY line, following ORDER BY doc_id, p) AS n FROM two WHERE following IS NOT NULL),
c AS (SELECT l.doc_id, l.p, line, coalesce(x.n > 1, false) OR coalesce(y.n > 1, false) AS gone FROM l LEFT JOIN nth x ON x.doc_id = l.doc_id AND x.p = l.p LEFT JOIN nth y ON y.doc_id = l.doc_id AND y.p = l.p - 1),
k AS (SELECT doc_id, count(*) AS n_lines, count_if(gone) AS n_removed, string_agg(line, chr(10) ORDER BY p) FILTER (NOT gone) AS kept FROM c GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, CASE WHEN text IS NOT NULL THEN sha256(coalesce(kept, '')) END AS kept_sha256 FROM documents d LEFT JOIN k USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    """SQL of the queries whose whole rows it can express; the others rest on trained weights, tokenizers, own hashes or file forms."""
    return {"op3_substring_dedup": SUBSTRINGS, "op5_line_dedup": LINES, "op7_minhash_near_dedup": NEAR_DUPLICATES}
