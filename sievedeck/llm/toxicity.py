"""Convolutional text classifier for toxicity, trained in numpy.

Words (runs of letters and digits, lower case) are hashed to ``2 ** BITS`` buckets;
buckets that ``LEAST_DOCS`` training documents have get a trained embedding, all
others are zero. Filters of widths 1, 2 and 3 run over the embeddings, the
greatest value of each filter in the document (0 at least) is a feature, and a logistic layer
makes the score, which Platt scaling calibrates on documents kept aside, moved so that the best
cut there is ``CUT``; the epoch of least loss there is kept. For
the operator's own decision, thresholds are calibrated for each language there.

Training sees at most ``train_rows`` labelled documents, those with the least id
hashes, of ``train_bytes`` together: documented bounds for a model of fixed size. Every document is scored,
whole. Only the text is an input of the score; labels, languages, sources and
ids are not.

Defined results: null and empty texts get the score of a document without words;
equal texts have equal scores; without labelled rows every score is 0.5; with
labels of one kind only, every score is that share; rows that share an id are scored one by one; an
empty table gives an empty result. Several labels of an id count as the greatest.
"""

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievedeck.llm.textvec import LOWER, only, span_hash, text_slices
from sievedeck.session import ensure_importable

BITS, LEAST_DOCS, DIM, FILTERS, WIDTHS = 23, 3, 8, 8, (1, 2, 3)
TRAIN_ROWS, TRAIN_BYTES, CUT = 6_000, 128 << 20, 0.7

_BREAK = np.ones(256, bool)
_BREAK[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def buckets(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash bucket and document of every word."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    data = LOWER[data]
    latin = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
    data[latin] += 0x20
    gap = _BREAK[data]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0] = after[-1] = True
    before[1:], after[:-1] = gap[:-1], gap[1:]
    inner = offs[(offs > 0) & (offs < n)]
    before[inner] = True
    after[inner - 1] = True
    starts, ends = np.flatnonzero(~gap & before), np.flatnonzero(~gap & after) + 1
    return (span_hash(data, starts, ends)[0] >> np.uint64(64 - BITS)).astype(np.int64), np.searchsorted(offs, starts, "right") - 1


def _padded(rows: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of all documents with zeros (the empty word) after each, where each document
    starts, and the windows that begin at no word, which count for nothing."""
    pad = max(WIDTHS)
    count = np.bincount(doc, minlength=n)
    out, none = np.zeros(len(rows) + pad * n, np.int64), np.ones(len(rows) + pad * n, bool)
    at = np.arange(len(rows)) + pad * doc
    out[at], none[at] = rows, False
    return out, np.cumsum(count + pad) - (count + pad), np.flatnonzero(none[: len(none) - pad + 1])


@dataclass
class ToxicityModel:
    """Trained weights: known buckets, their embeddings, filters and the logistic layer."""

    known: np.ndarray
    embeddings: np.ndarray
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    weights: np.ndarray
    offset: float
    scale: float = 1.0
    shift: float = 0.0
    constant: float | None = None
    thresholds: dict[str, float] = field(default_factory=dict)
    default: float = CUT
    _tables: tuple | None = None

    def __getstate__(self):
        return self.__dict__ | {"_tables": None}

    def tables(self) -> tuple[np.ndarray, list[list[np.ndarray]]]:
        """Row of each bucket, and what each row adds to the filters at each place of a window."""
        if self._tables is None:
            row = np.zeros(1 << BITS, np.int32)
            row[self.known] = np.arange(1, len(self.known) + 1)
            full = np.vstack([np.zeros((1, DIM), np.float32), self.embeddings])
            self._tables = row, [[full @ f[j] for j in range(w)] for w, f in zip(WIDTHS, self.filters, strict=True)]
        return self._tables

    def features(self, hashed: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        row, tables = self.tables()
        rows, starts, none = _padded(row[hashed], doc, n)
        size = len(rows) - max(WIDTHS) + 1
        out = []
        for w, table, bias in zip(WIDTHS, tables, self.bias, strict=True):
            z = table[0][rows[:size]]
            for j in range(1, w):
                z += table[j][rows[j : size + j]]
            z[none] = -1e9
            out.append(np.maximum(np.maximum.reduceat(z, starts, axis=0) + bias, 0))
        return np.hstack(out)

    def scores(self, hashed: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        if self.constant is not None:
            return np.full(n, self.constant)
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(hashed, doc, n) + self.shift, -40, 40)))

    def logits(self, hashed: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        """Summed feature by feature, so that a text's score is the same in any batch."""
        out = np.full(n, self.offset)
        for x, w in zip(self.features(hashed, doc, n).astype(np.float64).T, self.weights.astype(np.float64), strict=True):
            out += x * w
        return out

    def score_texts(self, texts: list[str | None] | pa.Array) -> np.ndarray:
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        parts = [self.scores(*buckets(data, offs), stop - row) for row, stop, data, offs in text_slices(texts)]
        return np.concatenate(parts) if parts else np.zeros(0)


def _platt(logit: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Scale and shift of least log loss, with the usual smoothed targets."""
    pos, neg = label.sum(), (1 - label).sum()
    target = np.where(label > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * logit + b, -40, 40)))
        w = p * (1 - p) + 1e-6
        hessian = np.array([[(w * logit * logit).sum() + 1e-3, (w * logit).sum()], [(w * logit).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(hessian, [((p - target) * logit).sum(), (p - target).sum()])
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-6:
            break
    return max(a, 1e-3), b


def gradients(p: dict[str, np.ndarray], rows: np.ndarray, starts: np.ndarray, none: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean log loss (with the penalty on weights and filters) of padded documents, and its gradient by each parameter."""
    n, size, kind = len(label), len(rows) - max(WIDTHS) + 1, p["E"].dtype
    places, features = [], []
    for w in WIDTHS:
        z = np.zeros((size, FILTERS), kind)
        for j in range(w):
            z += p["E"][rows[j : size + j]] @ p[f"F{w}"][j]
        z[none] = -1e9
        top = np.maximum.reduceat(z, starts, axis=0)
        span = np.repeat(np.arange(n), np.diff(np.append(starts, size)))
        hit = np.where(z == top[span], np.arange(size)[:, None], size)
        places.append(np.minimum.reduceat(hit, starts, axis=0))
        features.append(np.maximum(top + p[f"b{w}"], 0))
    x = np.hstack(features)
    logit = x @ p["v"] + p["c"]
    loss = np.logaddexp(0, (1 - 2 * label) * logit).mean() + 5e-5 * sum((p[k] ** 2).sum() for k in ("v", *(f"F{w}" for w in WIDTHS)))
    error = ((1 / (1 + np.exp(-logit)) - label) / n).astype(kind)
    g = {"v": x.T @ error + 1e-4 * p["v"], "c": np.array([error.sum()], kind)}
    dx = error[:, None] * p["v"] * (x > 0)
    dE = np.zeros_like(p["E"])
    for i, w in enumerate(WIDTHS):
        d = dx[:, i * FILTERS : (i + 1) * FILTERS]
        g[f"b{w}"], g[f"F{w}"] = d.sum(0), np.zeros_like(p[f"F{w}"])
        for j in range(w):
            words = rows[places[i] + j]
            g[f"F{w}"][j] = np.einsum("nfd,nf->df", p["E"][words], d)
            np.add.at(dE, words.reshape(-1), (d[:, :, None] * p[f"F{w}"][j].T[None]).reshape(-1, DIM))
        g[f"F{w}"] += 1e-4 * p[f"F{w}"]
    dE[0] = 0  # the row of unknown words stays zero
    g["E"] = dE
    return float(loss), g


def train(texts: list[str], labels: list[int], langs: list[str | None], epochs: int = 14, seed: int = 7) -> ToxicityModel:
    """Fit on four fifths of the rows, calibrate on the fifth, on which the best epoch is kept, too."""
    label = np.array(labels, np.float64)
    none = np.zeros(0)
    if len(set(labels)) < 2:
        return ToxicityModel(none.astype(int), none, [], [], none, 0.0, constant=float(labels[0]) if len(labels) else 0.5)
    docs = []
    for row, stop, data, offs in text_slices(pa.array(texts, pa.string())):
        hashed, doc = buckets(data, offs)
        edges = np.searchsorted(doc, np.arange(stop - row + 1))
        docs += [hashed[a:b] for a, b in zip(edges, edges[1:], strict=False)]
    r = np.random.default_rng(seed)
    order = r.permutation(len(docs))
    aside = np.sort(order[: max(1, len(docs) // 5)])
    fit = order[max(1, len(docs) // 5) :]
    if len(set(label[fit])) < 2 or len(set(label[aside])) < 2:
        fit = aside = order
    seen, times = np.unique(np.concatenate([np.unique(docs[k]) for k in fit]), return_counts=True)
    known = seen[times >= LEAST_DOCS]
    row = np.zeros(1 << BITS, np.int32)
    row[known] = np.arange(1, len(known) + 1)
    texts_rows = [row[d] for d in docs]
    p = {"E": r.normal(0, 0.1, (len(known) + 1, DIM)).astype(np.float32), "v": r.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32), "c": np.array([np.log(label.mean() / (1 - label.mean()))], np.float32)}
    # The first dimension starts from how far a word's share of toxic documents is off the mean.
    share = label[fit].mean()
    toxic = np.bincount(np.searchsorted(known, np.concatenate([np.intersect1d(docs[k], known) for k in fit if label[k]] or [known[:0]])), minlength=len(known)) if len(known) else np.zeros(0)
    times = times[times >= LEAST_DOCS]
    p["E"][1:, 0] += (0.1 * (toxic - times * share) / np.sqrt(times * share * (1 - share))).astype(np.float32)
    p["E"][0] = 0
    for w in WIDTHS:
        p[f"F{w}"] = r.normal(0, 0.4, (w, DIM, FILTERS)).astype(np.float32)
        p[f"b{w}"] = np.full(FILTERS, 0.05, np.float32)
    first = {k: np.zeros_like(x) for k, x in p.items()}
    second = {k: np.zeros_like(x) for k, x in p.items()}
    step, batch = 0, 64
    hashed, doc = np.concatenate([docs[k] for k in aside]), np.repeat(np.arange(len(aside)), [len(docs[k]) for k in aside])
    model, least = None, np.inf
    for epoch in range(epochs):
        rate = 0.02 * (1 - epoch / epochs) + 0.001
        shuffled = r.permutation(fit)
        for at in range(0, len(shuffled), batch):
            own = shuffled[at : at + batch]
            n = len(own)
            rows, starts, none = _padded(np.concatenate([texts_rows[k] for k in own]), np.repeat(np.arange(n), [len(texts_rows[k]) for k in own]), n)
            _, g = gradients(p, rows, starts, none, label[own])
            step += 1
            for k, x in p.items():
                first[k] += 0.1 * (g[k] - first[k])
                second[k] += 0.01 * (g[k] ** 2 - second[k])
                x -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)
        now = ToxicityModel(known, p["E"][1:].copy(), [p[f"F{w}"].copy() for w in WIDTHS], [p[f"b{w}"].copy() for w in WIDTHS], p["v"].copy(), float(p["c"][0]))
        logit = now.logits(hashed, doc, len(aside))
        now._tables = None  # of each epoch's model they would add up in the driver
        now.scale, now.shift = _platt(logit, label[aside])
        apart = (2 * label[aside] - 1) * (now.scale * logit + now.shift)
        loss = np.logaddexp(0, -apart).mean()
        if loss < least:
            model, least = now, loss
    # Scores are moved so that the best cut over all languages is the one of the yes-or-no prediction.
    cut = _threshold(model.scores(hashed, doc, len(aside)), label[aside])
    model.shift += np.log(CUT / (1 - CUT)) - np.log(cut / (1 - cut))
    score = model.scores(hashed, doc, len(aside))
    for lang in sorted({x for x in langs if x}):
        own = np.array([langs[k] == lang for k in aside])
        if own.sum() >= 30 and 3 <= label[aside][own].sum() < own.sum():
            model.thresholds[lang] = _threshold(score[own], label[aside][own])
    return model


def _threshold(score: np.ndarray, label: np.ndarray) -> float:
    """The middle of the cuts with the best F0.5: clean documents weigh more than missed ones."""
    cuts = np.round(np.arange(0.3, 0.951, 0.01), 2)
    best = []
    for c in cuts:
        hits = ((score >= c) & (label > 0)).sum()
        best.append(1.25 * hits / max(1e-9, 0.25 * label.sum() + (score >= c).sum()))
    top = np.flatnonzero(np.array(best) >= max(best) - 1e-9)
    return float(cuts[top[len(top) // 2]])


def training_rows(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "toxic", train_rows: int = TRAIN_ROWS, train_bytes: int = TRAIN_BYTES) -> list:
    """doc_id, text, lang, label of at most ``train_rows`` rows of at most ``train_bytes`` of whole texts together.

    Of the labelled ids whose crc32 modulo 3 is not 1 those with the least hashes; of their rows, in the
    same order, as many as stay within both bounds (a text that does not is passed over).
    """
    order = F.xxhash64("doc_id")
    drawn = (
        labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("doc_id IS NOT NULL AND label IS NOT NULL")
        .where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
        .groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(order, "doc_id").limit(train_rows)
    )
    few = df.sparkSession.createDataFrame(drawn.collect() or [], drawn.schema)
    # At most train_rows small rows, so the broadcast has a fixed bound.
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).join(F.broadcast(few), "doc_id")
    key = (order.alias("h"), "doc_id", F.xxhash64("text").alias("t"))
    sizes = docs.select(*key, F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")).orderBy("h", "doc_id", "t").limit(train_rows).collect()
    took, total = [], 0
    for r in sizes:
        if total + r["size"] <= train_bytes:
            took.append((r["doc_id"], r["t"]))
            total += r["size"]
    if not took:
        return []
    chosen = df.sparkSession.createDataFrame(sorted(set(took)), "doc_id long, t long")  # bounded as few is
    rows = docs.withColumn("t", F.xxhash64("text")).join(F.broadcast(chosen), ["doc_id", "t"]).limit(len(took)).collect()
    return sorted(rows, key=lambda r: (r["doc_id"], r["text"] or ""))


def fit_toxicity(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "toxic", train_rows: int = TRAIN_ROWS) -> ToxicityModel:
    """Train on at most ``train_rows`` of the labelled rows whose crc32(id) mod 3 is not 1."""
    rows = training_rows(df, labels, id_col, text_col, lang_col, label_col, train_rows)
    return train([r["text"] or "" for r in rows], [int(r["label"] > 0) for r in rows], [r["lang"] for r in rows])


def _scored(df: DataFrame, model: ToxicityModel, text_col: str):
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        only(("toxicity", id(shared.value)))
        return pa.array(shared.value.score_texts(texts))

    return score(F.col(text_col))


def score_toxicity(df: DataFrame, model: ToxicityModel, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """Add the score of every row."""
    ensure_importable(df.sparkSession)
    return df.withColumn(score_col, _scored(df, model, text_col))


def toxic_rows(df: DataFrame, model: ToxicityModel, text_col: str = "text", lang_col: str = "lang", out_col: str = "is_toxic") -> DataFrame:
    """Add whether a row's score reaches the threshold of its language."""
    ensure_importable(df.sparkSession)
    limit = F.lit(model.default)
    for lang, value in sorted(model.thresholds.items()):
        limit = F.when(F.col(lang_col) == lang, value).otherwise(limit)
    return df.withColumn(out_col, _scored(df, model, text_col) >= limit)
