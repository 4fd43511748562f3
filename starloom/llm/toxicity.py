"""Toxicity: a logistic classifier that may not tell groups of people apart.

Features of a text are how often it holds selected words and word beginnings, as
log(1 + times). They are chosen by the chi-square of their presence and the label; weights come from a
logistic fit whose loss adds, for every fitted sentence that names a group, the
squared change of its logit when the group is swapped for another of its kind.
A neutral mention of a group then moves no score.

Null and empty texts have no feature and get the score of the bias alone. Very
long texts are read whole. Repeated rows are scored each; repeated labels of one
document count once, the larger one. With no labels of both kinds the model is
the share of toxic labels (0 without any). Columns besides those named are kept.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.llm.common import encode_words, fold, give_back, sliced, small_slices, text_of

# Names of groups; a term is swapped for the others of its line.
IDENTITY = (
    ("women", "men", "girls", "boys", "transgender", "nonbinary"),
    ("woman", "man", "girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics"),
    ("gay", "lesbian", "bisexual", "straight", "queer", "homosexual", "heterosexual"),
    ("black", "white", "asian", "african", "latino", "arab", "european", "american"),
    ("immigrants", "refugees", "foreigners", "migrants", "citizens"),
    ("blind", "deaf", "disabled", "elderly", "young"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("muslime", "christen", "juden", "hindus"),
    ("femmes", "hommes", "filles", "garçons"),
    ("musulmans", "chrétiens", "juifs"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("musulmanes", "cristianos", "judíos"),
)
SWAPS = {w: tuple(x for x in line if x != w) for line in reversed(IDENTITY) for w in line}
WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[.!?\n]+")
BEGINNINGS = (3, 4, 5, 6)


def features_of(word: str) -> list[str]:
    """The word itself, and its beginnings marked with a hyphen; a group's name has no beginnings, so a swap changes it whole."""
    return [word] if word in SWAPS else [word, *(f"{word[:n]}-" for n in BEGINNINGS if len(word) > n)]


@dataclass(frozen=True)
class Params:
    """``sample_per_label`` bounds the labelled rows that are fitted, ``features`` the model."""

    sample_per_label: int = 10_000
    features: int = 4_096
    swap_penalty: float = 20.0
    l2: float = 0.002
    steps: int = 400


@dataclass
class Model:
    names: list[str] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0

    def scores(self, texts: list[str]) -> np.ndarray:
        words, codes, counts = encode_words([WORD.findall(t.lower()) for t in texts])
        index = {n: i for i, n in enumerate(self.names)}
        have = [[index[f] for f in features_of(w) if f in index] for w in words]
        some = np.fromiter((bool(x) for x in have), bool, len(have))
        logit = np.full(len(texts), self.bias)
        if len(codes):
            kept = some[codes]
            row = np.repeat(np.arange(len(texts)), counts)[kept]
            width = len(self.names)
            hits = [r * width + i for r, c in zip(row.tolist(), codes[kept].tolist(), strict=True) for i in have[c]]
            cell, times = np.unique(np.array(hits, np.int64), return_counts=True)
            logit += np.bincount(cell // width, self.weights[cell % width] * np.log1p(times), len(texts)) if len(cell) else 0
        return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))


def _count_features(batches):
    """Documents of each label that hold a feature, summed per task."""
    total: dict[str, list[int]] = {}
    for batch in small_slices(batches):
        for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            for f in {f for w in set(WORD.findall(text.lower())) for f in features_of(w)}:
                total.setdefault(f, [0, 0])[label] += 1
    names = list(total)
    yield pa.RecordBatch.from_pydict({
        "feature": pa.array(names, pa.string()),
        "clean": pa.array([total[n][0] for n in names], pa.int64()), "toxic": pa.array([total[n][1] for n in names], pa.int64())})


def swapped(sentence: list[str]) -> list[tuple[str, str]]:
    """(term, other term) for every group named in a sentence."""
    return [(w, other) for w in sentence if w in SWAPS for other in SWAPS[w]]


def _presence(names: list[str]):
    index = {n: i for i, n in enumerate(names)}

    def run(batches):
        for batch in small_slices(batches):
            ids, times, gone, come = [], [], [], []
            for text in batch.column("text").to_pylist():
                low = text.lower()
                held = Counter(index[f] for w in WORD.findall(low) for f in features_of(w) if f in index)
                ids.append(list(held))
                times.append(list(held.values()))
                pairs = {p for s in SENTENCE.split(low) for p in swapped(WORD.findall(s))}
                gone.append([index[a] for a, b in sorted(pairs) if a in index and b in index])
                come.append([index[b] for a, b in sorted(pairs) if a in index and b in index])
            yield pa.RecordBatch.from_pydict({
                "toxic": batch.column("toxic"), "ids": pa.array(ids, pa.list_(pa.int32())), "times": pa.array(times, pa.list_(pa.int32())),
                "gone": pa.array(gone, pa.list_(pa.int32())), "come": pa.array(come, pa.list_(pa.int32()))})

    return run


def train_rows(docs: DataFrame, labels: DataFrame, params: Params) -> DataFrame:
    """At most ``sample_per_label`` rows of each label, those with the smallest hash of the id."""
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.where(fold("doc_id", 5) != 0)
    some = [known.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(params.sample_per_label) for t in (0, 1)]
    # Both sides of the union are bounded by the parameter, so is what is broadcast.
    return docs.select("doc_id", text_of().alias("text")).join(F.broadcast(some[0].unionByName(some[1])), "doc_id").select("text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, params: Params = Params()) -> Model:
    rows = train_rows(docs, labels, params)
    counted = rows.mapInArrow(_count_features, "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    shares = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n0, n1 = shares.get(0, 0), shares.get(1, 0)
    if not n0 or not n1:
        return Model(bias=8.0 if n1 else -8.0)
    n, held = float(n0 + n1), F.col("clean") + F.col("toxic")
    apart = F.col("toxic") * F.lit(float(n0)) - F.col("clean") * F.lit(float(n1))
    strength = apart * apart * n / (held * (F.lit(n) - held + 1.0) * n0 * n1)
    chosen = counted.withColumn("strength", strength).where(held >= 3).orderBy(F.desc("strength"), "feature").limit(params.features)
    names = [r["feature"] for r in chosen.select("feature").collect()]
    names += sorted(set(SWAPS) - set(names))  # groups are always in the model, so that the penalty can act on them
    got = rows.mapInArrow(_presence(names), "toxic int, ids array<int>, times array<int>, gone array<int>, come array<int>").toArrow()
    model = _fit_weights(got, names, params)
    del got
    give_back()  # the driver goes on for long
    return model


def _fit_weights(got: pa.Table, names: list[str], params: Params) -> Model:
    """Full-batch Adam on the mean logistic loss + l2 + swap penalty; classes weigh the same."""
    got = got.take(pa.array(np.argsort(got["toxic"].to_numpy(), kind="stable"))).combine_chunks()
    flat = lambda c: pc.list_flatten(got[c]).combine_chunks().to_numpy() if got.num_rows else np.zeros(0, np.int32)
    y = got["toxic"].to_numpy().astype(float)
    size = pc.list_value_length(got["ids"]).to_numpy()
    row, col = np.repeat(np.arange(len(y), dtype=np.int32), size), flat("ids")
    value = np.log1p(flat("times").astype(float))
    out, new = flat("gone"), flat("come")
    weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    w, b = np.zeros(len(names)), 0.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, params.steps + 1):
        logit = b + np.bincount(row, w[col] * value, len(y))
        error = weight * (1 / (1 + np.exp(-np.clip(logit, -40, 40))) - y)
        grad = np.bincount(col, error[row] * value, len(w)) + params.l2 * w
        if len(out):
            change = params.swap_penalty * (w[out] - w[new]) / len(out)
            grad += np.bincount(out, change, len(w)) - np.bincount(new, change, len(w))
        gb = error.sum()
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        c1, c2 = 1 - 0.9**step, 1 - 0.999**step
        w -= 0.05 * (m / c1) / (np.sqrt(v / c2) + 1e-8)
        b -= 0.05 * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
    return Model(names, w, float(b))


def with_score(docs: DataFrame, model: Model, column: str = "toxicity_score") -> DataFrame:
    """All columns of ``docs`` and the score."""
    bound = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        out = sliced(texts, bound.value.scores)
        return pd.Series(np.concatenate(out) if out else np.zeros(0))

    return docs.withColumn(column, scored(text_of()))
