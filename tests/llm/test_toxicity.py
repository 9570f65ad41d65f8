import random
import re
import zlib

import numpy as np

from sievedeck.llm import textvec, toxicity
from tests.llm.conftest import table


def corpus(n=600, seed=5):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 7))) for _ in range(400)]
    bad = ["vilewort", "schlimmé", "Grubble"]
    out = []
    for k in range(n):
        text = [r.choice(words) for _ in range(r.randrange(5, 120))]
        label = int(r.random() < 0.2)
        if label:
            text[r.randrange(len(text))] = r.choice(bad) + r.choice(["", ",", "."])
        out.append((k, " ".join(text), label))
    return out


def test_held_out_accuracy(spark):
    rows = corpus()
    docs, labels = table(spark, [x[:2] for x in rows]), spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, labels)
    got = {r["doc_id"]: r["score2"] for r in toxicity.score_toxicity(docs, model, score_col="score2").collect()}
    held = [(got[k], y) for k, _, y in rows if zlib.crc32(str(k).encode()) % 3 == 1]
    assert np.mean([(s >= 0.7) == bool(y) for s, y in held]) > 0.95
    flags = {r["doc_id"]: r["is_toxic"] for r in toxicity.toxic_rows(docs, model).collect()}
    assert np.mean([flags[k] == bool(y) for k, _, y in rows]) > 0.95


def test_odd_rows(spark, odd, empty):
    model = toxicity.fit_toxicity(odd, spark.createDataFrame([(1, 0), (4, None), (None, 1), (40, 1), (40, 0), (16, 1)], "doc_id long, toxic int"))
    scores = [r["s"] for r in toxicity.score_toxicity(odd, model, score_col="s").collect()]
    assert len(scores) == odd.count() and all(0 <= s <= 1 for s in scores)
    none = toxicity.fit_toxicity(odd, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r["s"] for r in toxicity.score_toxicity(odd, none, score_col="s").collect()} == {0.5}
    assert toxicity.score_toxicity(empty, model, score_col="s").collect() == []


def test_score_of_a_text_does_not_depend_on_its_neighbours():
    rows = corpus(300)
    model = toxicity.train([t for _, t, _ in rows], [y for *_, y in rows], [None] * len(rows))
    together = model.score_texts([t for _, t, _ in rows[:40]] + ["", None])
    assert np.array_equal(together, np.concatenate([model.score_texts([t]) for _, t, _ in rows[:40]] + [model.score_texts([""])] * 2))


def test_scores_against_a_naive_forward_pass():
    """Word by word and window by window, in plain Python."""
    r = np.random.default_rng(3)
    texts = ["", "a", "bad words here", "Die ÄPFEL sind Gut. bad!", " ".join(r.choice(list("abcdefgh"), 200)), None]
    words = sorted({w for t in texts for w in re.findall(r"[0-9a-zà-öø-ÿ]+", (t or "").lower())})
    number = {}
    for w in words:
        data = np.frombuffer(w.encode(), np.uint8)
        number[w] = int(textvec.span_hash(data, np.array([0]), np.array([len(data)]))[0][0]) >> (64 - toxicity.BITS)
    known = np.unique(list(number.values()))[::2]
    model = toxicity.ToxicityModel(
        known, r.normal(0, 1, (len(known), toxicity.DIM)).astype(np.float32), [r.normal(0, 1, (w, toxicity.DIM, toxicity.FILTERS)).astype(np.float32) for w in toxicity.WIDTHS],
        [r.normal(0, 1, toxicity.FILTERS).astype(np.float32) for _ in toxicity.WIDTHS], r.normal(0, 1, toxicity.FILTERS * len(toxicity.WIDTHS)).astype(np.float32), 0.3, 0.7, -0.2,
    )
    row = {int(k): model.embeddings[i] for i, k in enumerate(known)}
    for text, score in zip(texts, model.score_texts(texts), strict=True):
        own = [row.get(number[w], np.zeros(toxicity.DIM)) for w in re.findall(r"[0-9a-zà-öø-ÿ]+", (text or "").lower())]
        z, at = 0.3, 0
        for w, filters, bias in zip(toxicity.WIDTHS, model.filters, model.bias, strict=True):
            padded = own + [np.zeros(toxicity.DIM)] * max(toxicity.WIDTHS)
            for f in range(toxicity.FILTERS):
                seen = [sum(float(padded[p + j] @ filters[j][:, f]) for j in range(w)) for p in range(len(own))]
                z += max(0.0, max(seen) + float(bias[f]) if seen else 0.0) * float(model.weights[at])
                at += 1
        assert abs(score - 1 / (1 + np.exp(-(0.7 * z - 0.2)))) < 1e-4, text


def test_gradients_against_differences():
    r = np.random.default_rng(5)
    p = {"E": r.normal(0, 1, (9, toxicity.DIM)), "v": r.normal(0, 1, toxicity.FILTERS * len(toxicity.WIDTHS)), "c": np.array([0.1])}
    p["E"][0] = 0
    for w in toxicity.WIDTHS:
        p[f"F{w}"], p[f"b{w}"] = r.normal(0, 1, (w, toxicity.DIM, toxicity.FILTERS)), r.normal(0, 0.3, toxicity.FILTERS)
    docs = [r.integers(0, 9, n) for n in (1, 4, 17, 30)]
    rows, starts, none = toxicity._padded(np.concatenate(docs), np.repeat(np.arange(4), [len(d) for d in docs]), 4)
    label = np.array([0.0, 1.0, 1.0, 0.0])
    _, g = toxicity.gradients(p, rows, starts, none, label)
    for name, x in p.items():
        for at in r.integers(0, x.size, 12):
            place = np.unravel_index(at, x.shape)
            if name == "E" and place[0] == 0:
                continue
            old, losses = x[place], []
            for step in (1e-6, -1e-6):
                x[place] = old + step
                losses.append(toxicity.gradients(p, rows, starts, none, label)[0])
            x[place] = old
            assert abs((losses[0] - losses[1]) / 2e-6 - g[name][place]) < 1e-4, (name, place)


def test_training_rows_are_bounded_in_rows_and_bytes(spark):
    docs = spark.createDataFrame([(k, "word " * 100 + str(c), "en") for k in range(60) for c in range(3)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, toxic int")
    free = [k for k in range(60) if zlib.crc32(str(k).encode()) % 3 != 1]
    rows = toxicity.training_rows(docs, labels)
    assert sorted({r["doc_id"] for r in rows}) == free and len(rows) == 3 * len(free)
    assert len(toxicity.training_rows(docs, labels, train_rows=7)) == 7
    few = toxicity.training_rows(docs, labels, train_bytes=2600)
    assert 0 < sum(len(r["text"]) for r in few) <= 2600 and len(few) == 5
    assert toxicity.training_rows(docs.limit(0), labels) == [] and toxicity.training_rows(docs, labels.limit(0)) == []
