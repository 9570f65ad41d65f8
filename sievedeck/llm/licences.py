"""Licence scans by a trained paragraph classifier, in SQL functions only.

Sparse logistic regression on word unigrams and bigrams tells licence families from each other, from
licences of no family listed here and from other text. It is fitted in numpy on notices of each family
(``TEMPLATES``), cut, shortened and padded at random; on the same notices with invented names in place of the
family's, which make the unknown class; and on ordinary and misleading sentences, loose words of the notices and
texts of none of their words. No row of the corpus is used. Probabilities are calibrated by a temperature on rows kept
aside, and the least probability of a family there is set so that 99 % of the wrong ones stay under it: below it
a notice is unknown, too. A prediction is confirmed if the paragraph and a template of the family
overlap: enough of the grams of the shorter one stand in the other.

Scanning is DataFrame operations. Paragraphs are lines. A paragraph can only be a notice if what its
grams can add for any family over other text reaches a bound that follows from the weights. A sum of one number for each
known word, which is never less than what the word's grams can add, drops the others exactly, within the row; what is left is
split into grams, joined with the table of weights, whose size is fixed by the templates (so
its broadcast is bounded), and summed by paragraph.

Defined results: null and empty texts have no paragraphs; licence paragraphs of rows that share an id are
counted together at each of them; rows with a null id have their paragraphs counted and no hits; an empty table gives
an empty result; only the named columns are read.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TEMPLATES = {
    "MIT": [
        "released under the mit license", "licensed under the mit license", "this software is distributed under the terms of the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "the software is provided as is without warranty of any kind express or implied",
    ],
    "Apache-2.0": [
        "licensed under the apache license version 2.0", "released under the apache license 2.0", "you may not use this file except in compliance with the license",
        "you may obtain a copy of the license at http www.apache.org licenses license-2.0",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind",
    ],
    "GPL": [
        "this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 2", "released under the gpl version 3", "licensed under gpl-3.0",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
        "you should have received a copy of the gnu general public license along with this program",
    ],
    "LGPL": ["licensed under the gnu lesser general public license version 3", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", "released under lgpl-2.1"],
    "AGPL": ["licensed under the gnu affero general public license version 3", "redistribute it under the terms of the gnu affero general public license", "released under agpl-3.0"],
    "BSD": [
        "licensed under the bsd license", "released under the bsd 3-clause license", "released under the 2-clause bsd license",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    ],
    "MPL-2.0": ["licensed under the mozilla public license version 2.0", "this source code form is subject to the terms of the mozilla public license v 2.0", "released under mpl-2.0"],
    "CC-BY": ["licensed under cc by 4.0", "this work is licensed under a creative commons attribution 4.0 international license", "available under the creative commons attribution license"],
    "CC-BY-SA": ["licensed under cc by-sa 4.0", "this work is licensed under a creative commons attribution sharealike 4.0 international license", "available under cc by-sa 3.0"],
    "CC-BY-NC": ["licensed under cc by-nc 4.0", "this work is licensed under a creative commons attribution noncommercial 4.0 international license", "available under cc by-nc 3.0", "licensed under cc by-nc-nd 4.0", "licensed under cc by-nc-sa 4.0"],
    "CC0": ["dedicated to the public domain under cc0 1.0", "this work is in the public domain under cc0", "released under cc0 1.0 universal public domain dedication"],
    "Proprietary": ["all rights reserved", "copyright all rights reserved no part of this publication may be reproduced", "this material is proprietary and confidential", "may not be copied or distributed without written permission of the copyright holder"],
}
OTHER = [
    "he got his driving license in may after three attempts", "the mit media lab opened a new building", "an apache helicopter landed near the village",
    "the license plate of the car was red", "copyright law is debated in parliament", "the public domain was discussed at length", "she works for a general hospital",
    "the creative director left the company", "they had no permission to enter the house", "the software was slow and the users were angry", "version 2 of the game was released in june",
    "the foundation gave money to the school", "the commons voted on the bill", "fishing without a license is forbidden there", "the terms of the contract were fair", "under the bridge there was a boat",
    "please read the documentation before you start", "he was licensed to practise medicine in two states", "the city is known for its rights movement", "the table was reserved for all of us",
    "this work is hard and takes a long time", "the bsd conference was held in ottawa", "warranty claims must be made within a year", "distributed systems are difficult to build",
    "available for rent from the first of april", "the source of the river lies in the hills", "all of the above are true", "the attribution of the painting is disputed", "no part of the story was true",
]
#: What names a family in its notices; invented names take their place in the rows of the unknown class.
NAMES = {
    "MIT": ("mit",), "Apache-2.0": ("apache", "www.apache.org"), "GPL": ("gnu", "gpl", "gpl-3.0"), "LGPL": ("gnu", "lesser", "lgpl-2.1"), "AGPL": ("gnu", "affero", "agpl-3.0"), "BSD": ("bsd",),
    "MPL-2.0": ("mozilla", "mpl-2.0"), "CC-BY": ("cc", "by", "creative", "commons"), "CC-BY-SA": ("cc", "by-sa", "creative", "commons"), "CC-BY-NC": ("cc", "by-nc", "by-nc-nd", "by-nc-sa", "creative", "commons"), "CC0": ("cc0",),
}
UNKNOWN = "unknown"
FAMILIES = [*TEMPLATES, UNKNOWN, ""]  # the last is other text
TOKEN = r"[a-z0-9]+(?:[.\-][a-z0-9]+)*"
#: Share of the grams of the shorter of paragraph and template, and number of grams, that must agree.
CONFIRM, LEAST_GRAMS = 0.6, 5
STEPS = 800


def grams(text: str) -> list[str]:
    tokens = re.findall(TOKEN, text.lower())
    return sorted({*tokens, *(f"{a} {b}" for a, b in zip(tokens, tokens[1:], strict=False))})


def _variants(r: np.random.Generator, text: str, filler: list[str], n: int) -> list[str]:
    """The text and n changed copies: a run of it, words left out, other words around it."""
    out, tokens = [text], text.split()
    for _ in range(n):
        own = list(tokens)
        if len(own) > 12:
            size = int(r.integers(8, len(own) + 1))
            at = int(r.integers(0, len(own) - size + 1))
            own = own[at : at + size]
        own = [w for w in own if r.random() > 0.06] or own
        for side in (0, len(own)):
            if r.random() < 0.4:
                own[side:side] = [filler[k] for k in r.integers(0, len(filler), int(r.integers(1, 6)))]
        out.append(" ".join(own))
    return out


def training_rows(r: np.random.Generator, variants: int) -> list[tuple[int, str]]:
    """Class and text of the rows to fit and calibrate on."""
    filler = sorted({w for s in OTHER for w in s.split()})
    rows = [(k, v) for k, own in enumerate(TEMPLATES.values()) for t in own for v in _variants(r, t, filler, variants * (3 if len(t.split()) > 12 else 1))]
    for family, names in NAMES.items():
        for t in TEMPLATES[family]:
            if set(names) & set(t.split()):
                rows += [(len(TEMPLATES), " ".join("qq" if w in names else w for w in v.split())) for v in _variants(r, t, filler, variants // 2) if set(names) & set(v.split())]
    other = len(TEMPLATES) + 1
    rows += [(other, v) for t in OTHER for v in _variants(r, t, filler, variants // 2)]
    rows += [(other, " ".join(filler[k] for k in r.integers(0, len(filler), int(r.integers(3, 25))))) for _ in range(600)]
    words = sorted({w for own in TEMPLATES.values() for t in own for w in t.split()})
    rows += [(other, w) for w in words]
    rows += [(other, " ".join(f"qq {words[k]}" for k in r.integers(0, len(words), int(r.integers(1, 6))))) for _ in range(600)]
    small = sorted({w for w in words if len(w) <= 5 and w.isalpha() and w in filler})  # the words of any prose
    rows += [(other, " ".join(small[k] if k < len(small) else "qq" for k in r.integers(0, 2 * len(small), int(r.integers(2, 80))))) for _ in range(1200)]
    # Pairs of words that notices share with any prose.
    common = {"of", "the", "and", "in", "to", "is", "a", "an", "it", "or", "on", "at", "by", "for", "with", "as", "be", "all", "any", "no", "this", "that", "from", "not", "may", "are", "you", "we", "us", "was", "has", "have", "its", "shall", "must", "your", "their", "under"}
    joined = sorted({g for own in TEMPLATES.values() for t in own for g in grams(t) if " " in g and set(g.split()) <= common}) + sorted(common & set(words))
    rows += [(other, " qq ".join(joined[k] for k in r.integers(0, len(joined), int(r.integers(1, 30))))) for _ in range(1500)]
    return rows + [(other, "qq")] * 600


@lru_cache
def model(seed: int = 5, variants: int = 24) -> dict:
    """weights {gram: one a class}, bias, temperature, threshold, least evidence, mass {word: most its grams can add}, and templates."""
    r = np.random.default_rng(seed)
    rows = training_rows(r, variants)
    made = [[g for g in grams(t) if "qq" not in g] for _, t in rows]
    aside = r.random(len(rows)) < 0.25
    times: dict[str, int] = {}
    for own, a in zip(made, aside, strict=True):
        for g in own if not a else ():
            times[g] = times.get(g, 0) + 1
    vocabulary = {g: k for k, g in enumerate(sorted(g for g, n in times.items() if n > 1))}
    codes = [[vocabulary[g] for g in own if g in vocabulary] for own in made]
    y = np.array([f for f, _ in rows])
    w, b = np.zeros((len(vocabulary), len(FAMILIES))), np.zeros(len(FAMILIES))

    def logits(which: np.ndarray) -> np.ndarray:
        out = np.tile(b, (len(which), 1))
        n = np.array([len(codes[k]) for k in which])
        some = np.flatnonzero(n)
        out[some] += np.add.reduceat(w[np.concatenate([codes[k] for k in which]).astype(np.int64)], (np.cumsum(n) - n)[some])
        return out

    fit = np.flatnonzero(~aside)
    column = np.concatenate([codes[k] for k in fit]).astype(np.int64)
    row = np.repeat(np.arange(len(fit)), [len(codes[k]) for k in fit])
    by_column = np.argsort(column, kind="stable")
    edges = np.searchsorted(column[by_column], np.arange(len(vocabulary)))
    moving = np.zeros_like(w)
    for step in range(STEPS):
        p = _softmax(logits(fit)) - np.eye(len(FAMILIES))[y[fit]]
        moving = 0.9 * moving + np.add.reduceat(p[row[by_column]], edges) / len(fit) + 2e-4 * w
        w -= 3 * moving * (1 - step / STEPS)
        b -= 0.5 * p.mean(0)
    w, b = np.round(w, 4), np.round(b, 4)
    away = np.flatnonzero(aside)
    z, truth = logits(away), y[aside]
    loss = lambda t: -np.log(_softmax(z / t)[np.arange(len(z)), truth]).mean()
    temperature = round(float(min(np.arange(0.3, 3.01, 0.05), key=loss)), 2)
    families = _softmax(z / temperature)[:, : len(TEMPLATES)]
    wrong = families.max(1)[families.argmax(1) != truth]
    threshold = round(float(np.clip(np.quantile(wrong, 0.99) if len(wrong) else 0.5, 0.5, 0.9)), 3)
    # Other text is less probable than one half only if some class is ahead of it by more than -T log(classes - 1).
    least = float(b[-1] - b[:-1].max() - temperature * np.log(len(FAMILIES) - 1))
    ahead = w[:, :-1] - w[:, -1:]
    most: dict[str, np.ndarray] = {}
    prose = " ".join(OTHER).split()
    for g, k in vocabulary.items():
        # A word adds what it does; a bigram, which may be there or not, counts at the word that is rarer in prose if it adds.
        word = min(g.split(), key=lambda x: (prose.count(x), -len(x), x))
        most[word] = most.get(word, 0) + (ahead[k] if word == g else np.maximum(0, ahead[k]))
    mass = {word: float(own.max()) for word, own in most.items()}
    return {
        "weights": {g: w[k].tolist() for g, k in vocabulary.items()}, "bias": b.tolist(), "temperature": temperature, "threshold": threshold, "least": least,
        "mass": {x: m for x, m in mass.items() if m}, "templates": [(k, grams(t)) for k, own in enumerate(TEMPLATES.values()) for t in own],
    }


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def may_be_notice(tokens: Column) -> Column:
    """Whether a paragraph of these words can have less than one half for other text: false only if it surely cannot."""
    m = model()
    if m["least"] <= 0:  # a paragraph without a known word could
        return F.lit(True)
    known = F.array_intersect(tokens, F.lit(sorted(m["mass"])))
    mass = F.from_json(F.lit(json.dumps(m["mass"])), "map<string,double>")
    return F.aggregate(known, F.lit(1e-6), lambda total, w: total + F.element_at(mass, w)) >= m["least"]


def licence_paragraphs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, paragraph, family, probability, similarity, verdict of every paragraph that is a notice more probably than not.

    The verdict is confirmed (a family, and one of its templates agrees), unconfirmed (none does), or
    unknown (a licence of no family here, or no family is probable enough).
    """
    spark, m = df.sparkSession, model()
    width, families = len(FAMILIES), len(TEMPLATES)
    source = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(F.col("doc_id").isNotNull() & (F.col("text") != ""))
    tokens = F.regexp_extract_all(F.lower("line"), F.lit(TOKEN), F.lit(0))
    lines = source.select("doc_id", F.posexplode(F.split("text", "\n")).alias("paragraph", "line")).where(F.col("line") != "")
    lines = lines.select("doc_id", "paragraph", tokens.alias("tokens")).where(may_be_notice(F.col("tokens")))
    pairs = F.zip_with(F.slice("tokens", 1, F.greatest(F.size("tokens") - 1, F.lit(0))), F.slice("tokens", 2, F.greatest(F.size("tokens") - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    exploded = lines.select("doc_id", "paragraph", F.explode(F.array_distinct(F.concat("tokens", pairs))).alias("gram"))
    said = [set(own) for _, own in m["templates"]]
    table = spark.createDataFrame(
        [(g, m["weights"].get(g, [0.0] * width), [int(g in own) for own in said]) for g in sorted({*m["weights"], *(g for own in said for g in own)})],
        "gram string, w array<double>, t array<int>",
    )
    # As many rows as the templates have grams, whatever the corpus.
    joined = exploded.join(F.broadcast(table), "gram", "left")
    sums = joined.groupBy("doc_id", "paragraph").agg(
        F.count("*").alias("n"), *(F.sum(F.coalesce(F.col("w")[k], F.lit(0.0))).alias(f"w{k}") for k in range(width)), *(F.sum(F.coalesce(F.col("t")[k], F.lit(0))).alias(f"t{k}") for k in range(len(said))),
    )
    logits = [(F.col(f"w{k}") + F.lit(m["bias"][k])) / m["temperature"] for k in range(width)]
    scored = sums.withColumn("z", F.array(*logits)).withColumn("z", F.transform("z", lambda v: F.exp(v - F.array_max("z"))))
    total = F.aggregate("z", F.lit(0.0), lambda a, v: a + v)
    best = F.array_max(F.slice("z", 1, families))
    overlap = lambda k: F.when(F.col(f"t{k}") >= LEAST_GRAMS, F.col(f"t{k}") / F.least(F.col("n"), F.lit(len(said[k])))).otherwise(0.0)
    alike = F.array(*(F.greatest(F.lit(0.0), *(overlap(k) for k, (f, _) in enumerate(m["templates"]) if f == family)) for family in range(families)))
    scored = scored.select(
        "doc_id", "paragraph", (best / total).alias("probability"), (F.element_at("z", families + 1) / total).alias("unknown"), (F.element_at("z", width) / total).alias("other"),
        F.array_position(F.slice("z", 1, families), best).cast("int").alias("at"), alike.alias("alike"),
    ).where("other < 0.5")
    named = scored.select(
        "doc_id", "paragraph", F.element_at(F.lit(FAMILIES[:families]), F.col("at")).alias("family"), F.round("probability", 6).alias("probability"), F.round(F.element_at("alike", F.col("at")), 6).alias("similarity"),
        ((F.col("unknown") > F.col("probability")) | (F.round("probability", 6) < m["threshold"])).alias("strange"),
    )
    verdict = F.when(F.col("strange"), UNKNOWN).when(F.col("similarity") >= CONFIRM, "confirmed").otherwise("unconfirmed")
    return named.select("doc_id", "paragraph", F.when(~F.col("strange"), F.col("family")).alias("family"), "probability", "similarity", verdict.alias("verdict"))


def licence_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_paragraphs, n_confirmed, n_unconfirmed, n_unknown, families, best_family, probability of every row."""
    hits = licence_paragraphs(df, id_col, text_col)
    count = lambda v: F.count(F.when(F.col("verdict") == v, 1))
    sure = F.col("verdict") == "confirmed"
    by_doc = hits.groupBy(F.col("doc_id").alias("found")).agg(
        count("confirmed").alias("n_confirmed"), count("unconfirmed").alias("n_unconfirmed"), count("unknown").alias("n_unknown"),
        F.array_join(F.array_sort(F.collect_set(F.when(sure, F.col("family")))), ",").alias("families"),
        F.max(F.when(sure, F.struct(F.col("probability"), F.col("family")))).alias("best"),
    )
    docs = df.select(F.col(id_col).alias("doc_id"), F.when(F.coalesce(F.col(text_col), F.lit("")) == "", 0).otherwise(F.size(F.split(F.col(text_col), "\n"))).cast("long").alias("n_paragraphs"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return docs.join(by_doc, docs["doc_id"] == F.col("found"), "left").select(
        "doc_id", "n_paragraphs", zero("n_confirmed"), zero("n_unconfirmed"), zero("n_unknown"),
        F.coalesce("families", F.lit("")).alias("families"), F.col("best.family").alias("best_family"), F.col("best.probability").alias("probability"),
    )
