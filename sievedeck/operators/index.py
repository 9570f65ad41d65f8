"""TF-IDF index as long tables, ranked search, and Rocchio feedback."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievedeck.functions.text import INDEX_WORD, WORD, tokens
from sievedeck.session import discard, staged, unused


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal a table of few input partitions over the cores; larger ones stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def preprocess(
    df: DataFrame, text_col: str = "text", normalizer: Callable[[Column], Column] | None = None, stop_words: list[str] | None = None, lemmas: DataFrame | None = None,
    id_col: str = "doc_id", tokenizer: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Normalise, tokenise, drop stop words, then look lemmas up (surface, lemma); a text of words joined by spaces.

    The normaliser and the tokenizer (a text's words as an array; words of letters, digits and
    underscores by default) are functions of columns; words without a lemma stay. Words are
    matched before lower-casing, as stop words are.
    """
    text = normalizer(F.col(text_col)) if normalizer else F.col(text_col)
    words = tokenizer(text) if tokenizer else F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    if stop_words:
        words = F.filter(words, lambda w: ~w.isin(list(stop_words)))
    if lemmas is None:
        return df.withColumn(text_col, F.array_join(words, " "))
    rows = df.select(id_col, F.posexplode_outer(words).alias("pos", "surface")).join(lemmas.select("surface", "lemma"), "surface", "left")
    joined = rows.groupBy(id_col).agg(F.array_sort(F.collect_list(F.when(F.col("surface").isNotNull(), F.struct("pos", F.coalesce("lemma", "surface").alias("w"))))).alias("ws"))
    return df.drop(text_col).join(joined.select(id_col, F.array_join("ws.w", " ").alias(text_col)), id_col)


def parse_ranks(text: str | None) -> list[int]:
    """Ranks from a line of numbers separated by spaces; an empty line is no rank. Others raise ValueError."""
    ranks = [int(x) for x in (text or "").split()]
    if min(ranks, default=0) < 0:
        raise ValueError("ranks start at 0")
    return ranks


@dataclass
class TfidfIndex:
    """rows(doc_id, term, tf, x), vocab(term, df, idf) and docs(doc_id, and length where stored).

    ``x`` is tf times idf. An index as built is a plan: a search over it is one aggregation by document,
    of lengths and products together, and ``rows`` then have a row without a weight for terms outside the
    vocabulary and for documents without words, so no document is missing from it. A stored one
    (``staged`` or ``load``) has the rows of the vocabulary alone and the documents' lengths, and is searched by term.
    """

    rows: DataFrame
    vocab: DataFrame
    docs: DataFrame
    stored: bool = False
    counts: DataFrame | None = None
    bounds: tuple[int, float] = (1, 1.0)

    @classmethod
    def build(cls, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_df: int = 1, max_df: float = 1.0) -> TfidfIndex:
        docs = spread(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("text IS NOT NULL"), "doc_id")
        tf = docs.select("doc_id", F.explode_outer(tokens(F.col("text"), INDEX_WORD)).alias("term")).groupBy("doc_id", "term").agg(F.count("term").alias("tf"))
        return cls._of(tf, docs.select("doc_id"), (min_df, max_df))

    @classmethod
    def _of(cls, tf: DataFrame, docs: DataFrame, bounds: tuple[int, float], keep=lambda table: table) -> TfidfIndex:
        size = docs.agg(F.count("*").alias("n"))  # one row
        vocab = tf.where("term IS NOT NULL").groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(size)).where((F.col("df") >= bounds[0]) & (F.col("df") <= bounds[1] * F.col("n")))
        vocab = keep(vocab.select("term", "df", (F.log((1 + F.col("n")).cast("double") / (1 + F.col("df"))) + 1).alias("idf")))
        rows = tf.join(vocab, "term", "left").select("doc_id", "term", "tf", (F.col("tf") * F.col("idf")).alias("x"))
        return cls(rows, vocab, docs, counts=tf, bounds=bounds)

    @property
    def weights(self) -> DataFrame:
        """doc_id, term, tf, w of all terms of the vocabulary; w is normalised by document."""
        if self.stored:
            return self.rows.join(self.docs, "doc_id").select("doc_id", "term", "tf", (F.col("x") / F.col("length")).alias("w"))
        length = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("doc_id")))
        return self.rows.where("x IS NOT NULL").select("doc_id", "term", "tf", (F.col("x") / length).alias("w"))

    def _store(self, write: Callable[[DataFrame, str], DataFrame]) -> TfidfIndex:
        """The index with its tables written; counts of words are worked out once and go when they have been used."""
        counts = staged(self.counts, "counts")
        made = TfidfIndex._of(counts, self.docs, self.bounds, lambda vocab: write(vocab, "vocab"))
        rows = write(made.rows.where("x IS NOT NULL"), "rows")
        lengths = rows.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("length"))
        docs = write(self.docs.join(lengths, "doc_id", "left").select("doc_id", F.coalesce("length", F.lit(0.0)).alias("length")), "docs")
        discard(counts)
        return TfidfIndex(rows, made.vocab, docs, True)

    def staged(self) -> TfidfIndex:
        """The index written to the shared folder, for several searches; see ``discard``."""
        out = self._store(staged)
        out._staged = [out.rows, out.vocab, out.docs]
        return out

    def discard(self) -> None:
        """Delete what ``staged`` wrote."""
        discard(*self.__dict__.pop("_staged", ()))

    def save(self, path: str) -> None:
        def write(table: DataFrame, name: str) -> DataFrame:
            table.write.mode("overwrite").parquet(f"{path}/{name}")
            return table.sparkSession.read.schema(table.schema).parquet(f"{path}/{name}")

        self._store(write)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TfidfIndex:
        return cls(*(spark.read.parquet(f"{path}/{name}") for name in ("rows", "vocab", "docs")), stored=True)

    def query_vectors(self, queries: DataFrame) -> DataFrame:
        """query_id, term, w (normalised) of queries(query_id, text); words outside the vocabulary are dropped."""
        tf = queries.select("query_id", F.explode(tokens(F.col("text"), INDEX_WORD)).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("tf"))
        raw = tf.join(self.vocab, "term").select("query_id", "term", (F.col("tf") * F.col("idf")).alias("w"))
        norm = raw.groupBy("query_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
        return raw.join(norm, "query_id").select("query_id", "term", (F.col("w") / F.col("norm")).alias("w"))

    def query_vector(self, text: str) -> DataFrame:
        """term, w of one query."""
        one = self.rows.sparkSession.range(1).select(F.lit(0).alias("query_id"), F.lit(text).alias("text"))
        return self.query_vectors(one).select("term", "w")

    def rank_all(self, vector: DataFrame) -> DataFrame:
        """doc_id, score (cosine with the vector (term, w), rounded to 6) of every document, 0 where nothing matches."""
        own = vector.agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("qnorm"))  # one row
        met = self.rows.join(vector.select("term", F.col("w").alias("qw")), "term", "inner" if self.stored else "left").groupBy("doc_id")
        dot = F.sum(F.col("x") * F.col("qw")).alias("dot")
        dots = self.docs.join(met.agg(dot), "doc_id", "left") if self.stored else met.agg(dot, F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("length"))
        score = F.round(F.coalesce(F.try_divide("dot", F.col("length") * F.col("qnorm")), F.lit(0.0)), 6)
        return dots.crossJoin(F.broadcast(own)).select("doc_id", score.alias("score"))

    def top(self, vector: DataFrame, k: int) -> DataFrame:
        """rank (from 0), doc_id, score of the first k, by score and then greater id."""
        best = self.rank_all(vector).orderBy(F.desc("score"), F.desc("doc_id")).limit(k)
        return best.select((F.row_number().over(Window.orderBy(F.desc("score"), F.desc("doc_id"))) - 1).alias("rank"), "doc_id", "score")

    def search(self, text: str, k: int | None = None) -> DataFrame:
        vector = self.query_vector(text)
        return self.rank_all(vector) if k is None else self.top(vector, k)

    def search_batch(self, queries: DataFrame, k: int) -> DataFrame:
        """query_id, rank, doc_id, score of the first k documents of each query.

        Documents without a common term matter only where fewer than k have one; then the k greatest
        ids that are not among them follow, so no query meets all documents.
        """
        vectors = self.query_vectors(queries)
        scored = self.weights.join(vectors.select("query_id", "term", F.col("w").alias("qw")), "term").groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("w") * F.col("qw")), 6).alias("score"))
        nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("doc_id")))
        first = scored.withColumn("nth", nth).where(F.col("nth") <= k).drop("nth")
        last = self.docs.select("doc_id").orderBy(F.desc("doc_id")).limit(2 * k)  # of these, k at least are not among a query's first k
        padding = queries.select("query_id").crossJoin(F.broadcast(last)).withColumn("score", F.lit(0.0))
        both = first.unionByName(padding.select("query_id", "doc_id", "score")).groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))
        return both.withColumn("nth", nth).where(F.col("nth") <= k).select("query_id", (F.col("nth") - 1).alias("rank"), "doc_id", "score")

    def centroid(self, marked: DataFrame) -> DataFrame:
        """term, w: the mean vector of the marked documents, missing terms as zeros."""
        n = marked.agg(F.count("*").alias("n"))
        total = self.weights.join(marked.select("doc_id"), "doc_id").groupBy("term").agg(F.sum("w").alias("w"))
        return total.crossJoin(F.broadcast(n)).select("term", (F.col("w") / F.col("n")).alias("w"))

    def rocchio(self, vector: DataFrame, relevant: DataFrame | None, non_relevant: DataFrame | None, alpha: float = 1.0, beta: float = 0.75, gamma: float = 0.25) -> DataFrame:
        """term, w: the vector moved to the relevant and from the other documents (doc_id); negatives stay."""
        parts = vector.select("term", (alpha * F.col("w")).alias("w"))
        for marked, factor in ((relevant, beta), (non_relevant, -gamma)):
            if marked is not None:
                parts = parts.unionByName(self.centroid(marked).select("term", (factor * F.col("w")).alias("w")))
        return parts.groupBy("term").agg(F.sum("w").alias("w"))

    def feedback_search(self, text: str, relevant_ranks: list[int] | str, non_relevant_ranks: list[int] | str, k: int = 5) -> DataFrame:
        """Search, mark ranks (from 0; lists, or lines of numbers) of the first result, move the query, search again."""
        marks = [parse_ranks(x) if isinstance(x, str) else x for x in (relevant_ranks, non_relevant_ranks)]
        if min([0, *marks[0], *marks[1]]) < 0:
            raise ValueError("ranks start at 0")
        vector = self.query_vector(text)
        first = self.top(vector, max([*marks[0], *marks[1]]) + 1) if marks[0] or marks[1] else None
        marked = [first.where(F.col("rank").isin(ranks)) if ranks else None for ranks in marks]
        return self.top(self.rocchio(vector, *marked), k)


def positions(df: DataFrame, order: Column | str) -> DataFrame:
    """Add doc_id counted from 0 by an order, for tables without a key.

    The sorted table is staged with the number of the range each row is in; rows are counted within
    their range, after the rows of all ranges before, so only one number a range meets in one task.
    """
    (part,) = unused(df, "__part")
    ranges = staged(df.orderBy(order).withColumn(part, F.spark_partition_id()), "positions")
    sizes = ranges.groupBy(part).agg(F.count("*").alias("__n"))
    before = sizes.select(part, (F.sum("__n").over(Window.orderBy(part)) - F.col("__n")).alias("__before"))
    nth = F.row_number().over(Window.partitionBy(part).orderBy(order)) - 1
    return ranges.withColumn("doc_id", nth).join(F.broadcast(before), part).withColumn("doc_id", (F.col("__before") + F.col("doc_id")).cast("long")).drop(part, "__before")
