"""Language ID: interpolated Kneser-Ney character models, one per language.

A text is read as its words (runs of letters, lower case). The model of a
language gives each character of a word a probability from up to four characters
before it inside the word; the word's ends are characters too. Probabilities and
back-off weights stand beside sorted arrays of hashed n-grams. The language with
the lowest cross-entropy per character wins. A text is rejected where even the
winner's cross-entropy lies far above what texts of that language show in a
calibration part of the fitted rows that is kept out of the counts.

Null texts and texts without a letter get ``und``, score 0, rejected. Without any
learned language all texts do. Very long texts are read whole, repeated rows each.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starloom.llm.common import encode_words, fold, mixed, sliced, small_slices, sums_by, written

WORD = re.compile(r"[^\W\d_]+")
START, END = 2, 3


@dataclass(frozen=True)
class Params:
    """``docs_per_language`` bounds the labelled rows that are fitted; one in ``calibrate_one_in`` is for calibration."""

    order: int = 5
    docs_per_language: int = 2_000
    calibrate_one_in: int = 5
    tolerance: float = 12.0


def windows(words: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """For every character of the words and their ends: itself and ``order - 1`` before it.

    Returns (characters x order, oldest first; 0 before a word's start) and characters per word.
    """
    size = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
    pad = order - 1
    joined = np.frombuffer("".join(f"{chr(0) * (pad - 1)}{chr(START)}{w}{chr(END)}" for w in words).encode("utf-32-le"), "<u4")
    ends = np.cumsum(size + pad)
    keep = np.ones(len(joined), bool)
    for k in range(pad):
        keep[ends - size - pad + k] = False
    at = np.flatnonzero(keep)
    return np.stack([joined[at - pad + k] for k in range(order)], 1) if len(at) else np.zeros((0, order), "<u4"), size


def hashed(chars: np.ndarray) -> np.ndarray:
    """64-bit hash of each row of characters."""
    h = np.full(len(chars), 0x51ED270B35B4F1D3 + chars.shape[1], np.uint64)
    for k in range(chars.shape[1]):
        h = mixed(h ^ chars[:, k].astype(np.uint64), k)
    return h


def _look(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, missing: float) -> np.ndarray:
    if not len(keys):
        return np.full(len(wanted), missing)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], missing)


class KneserNey:
    """Sorted hash arrays of one language: per order the interpolated probability, per context the back-off."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, alphabet: int):
        """``grams``: distinct windows of the highest order, oldest character first."""
        order = grams.shape[1]
        self.order, self.probs, self.backs = order, {}, {}
        tables: dict[int, tuple[np.ndarray, np.ndarray]] = {order: (grams, counts.astype(float))}
        for n in range(order - 1, 0, -1):  # lower orders count how many characters stand before a gram
            shorter, inverse = np.unique(tables[n + 1][0][:, 1:], axis=0, return_inverse=True)
            tables[n] = shorter, np.bincount(inverse.ravel(), minlength=len(shorter)).astype(float)
        for n in range(1, order + 1):
            rows, c = tables[n]
            n1, n2 = (c == 1).sum(), (c == 2).sum()
            discount = min(0.95, max(0.05, n1 / (n1 + 2 * n2))) if n1 + n2 else 0.5
            context, inverse = np.unique(rows[:, :-1], axis=0, return_inverse=True) if n > 1 else (np.zeros((1, 0), rows.dtype), np.zeros(len(rows), np.int64))
            inverse = inverse.ravel()
            total = np.bincount(inverse, c, len(context))
            back = discount * np.bincount(inverse, minlength=len(context)) / total
            lower = 1.0 / alphabet if n == 1 else self.probability(rows[:, 1:], n - 1)
            p = (c - discount) / total[inverse] + back[inverse] * lower
            h, g = hashed(rows), hashed(context)
            i, j = np.argsort(h), np.argsort(g)
            self.probs[n], self.backs[n] = (h[i], p[i]), (g[j], back[j])
            if n == 1:
                self.floor = back[0] / alphabet  # of a character never seen

    def probability(self, rows: np.ndarray, upto: int | None = None) -> np.ndarray:
        upto = upto or self.order
        p = _look(*self.probs[1], hashed(rows[:, -1:]), self.floor)
        for n in range(2, upto + 1):
            full = _look(*self.probs[n], hashed(rows[:, -n:]), -1.0)
            p = np.where(full >= 0, full, p * _look(*self.backs[n], hashed(rows[:, -n:-1]), 1.0))
        return p


@dataclass
class Model:
    names: list[str] = field(default_factory=list)
    models: list[KneserNey] = field(default_factory=list)
    limits: np.ndarray = field(default_factory=lambda: np.zeros(0))
    sharpness: float = 8.0
    order: int = 5

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Nats per character of each text under each language; characters read (0: no letter)."""
        words, codes, counts = encode_words([WORD.findall((t or "").lower()) for t in texts])
        letters = np.fromiter((any(c.isalpha() for c in w) for w in words), bool, len(words))
        rows, size = windows(words, self.order)
        h = hashed(rows)
        keys, first = np.unique(h, return_index=True)
        distinct = rows[first]
        cost = np.stack([-np.log(m.probability(distinct)) for m in self.models], 1) if len(distinct) else np.zeros((0, len(self.models)))
        per_word = sums_by(cost[np.searchsorted(keys, h)], size) * letters[:, None]
        chars = np.where(letters, size, 0)
        total = sums_by(per_word[codes] if len(codes) else np.zeros((0, len(self.models))), counts)
        n = sums_by(chars[codes] if len(codes) else np.zeros(0, np.int64), counts)
        return total / np.maximum(n, 1)[:, None], n

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and rejection of each text."""
        if not self.names:
            return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        cost, n = self.entropies(texts)
        best = cost.argmin(1)
        low = cost[np.arange(len(texts)), best]
        share = 1 / np.exp(-self.sharpness * (cost - low[:, None])).sum(1)
        none = n == 0
        # A short text strays further from the mean of its language.
        out = none | (low > self.limits[best] * (1 + 4 / np.sqrt(np.maximum(n, 1))))
        return [("und" if z else self.names[i]) for i, z in zip(best, none, strict=True)], np.where(none, 0.0, share), out


def sample(docs: DataFrame, params: Params) -> DataFrame:
    """At most ``docs_per_language`` rows a language, those with the smallest hash of id and text.

    Only hashes are ranked; what is broadcast has a row for each language or for
    each chosen document, as bounded as the models, which are broadcast too.
    """
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL").where(fold("doc_id", 5) != 0).select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    # A share that holds enough rows of each language is cut out first, so that only it is ordered.
    counts = known.groupBy("lang").agg(F.count("*").alias("n"))
    share = F.least(F.lit(1.0), F.lit(params.docs_per_language * 1.5 + 200) / F.col("n"))
    place = F.pmod("h", F.lit(1 << 20))
    near = known.select("lang", "h").join(F.broadcast(counts), "lang").where(place < share * (1 << 20)).select("lang", "h").distinct()
    ranked = near.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(place, "h"))).where(F.col("r") <= params.docs_per_language)
    chosen = ranked.select("lang", "h", (F.col("r") % params.calibrate_one_in == 0).alias("kept_out"))
    return known.join(F.broadcast(chosen), ["lang", "h"]).dropDuplicates(["lang", "h"]).select("lang", "text", "kept_out")


def _count_words(batches):
    for batch in small_slices(batches):
        total: dict[tuple[str, str], int] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            for w in WORD.findall(text.lower()):
                total[lang, w] = total.get((lang, w), 0) + 1
        yield pa.RecordBatch.from_pydict({
            "lang": pa.array([k[0] for k in total], pa.string()), "word": pa.array([k[1] for k in total], pa.string()), "n": pa.array(list(total.values()), pa.int64())})


def _count_grams(order: int):
    def run(batches):
        for batch in small_slices(batches, "word", 1 << 20):
            frame = batch.to_pandas()
            for lang, part in frame.groupby("lang"):
                rows, size = windows(part["word"].tolist(), order)
                grams, inverse = np.unique(rows, axis=0, return_inverse=True)
                n = np.bincount(inverse.ravel(), np.repeat(part["n"].to_numpy(), size), len(grams)).astype(np.int64)
                yield pa.RecordBatch.from_pydict({
                    "lang": pa.array([lang] * len(grams), pa.string()), "gram": pa.array([g.tobytes() for g in grams.astype("<u4")], pa.binary()), "n": pa.array(n, pa.int64())})

    return run


def fit(docs: DataFrame, params: Params = Params()) -> Model:
    rows = written(sample(docs, params), "language-sample")
    words = rows.where("NOT kept_out").mapInArrow(_count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    grams = words.mapInArrow(_count_grams(params.order), "lang string, gram binary, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    if grams.empty:
        return Model()
    grams = grams.sort_values(["lang", "gram"])
    model = Model(order=params.order)
    decoded = {lang: (np.frombuffer(b"".join(part["gram"]), "<u4").reshape(-1, params.order), part["n"].to_numpy()) for lang, part in grams.groupby("lang")}
    alphabet = 2 * len(np.unique(np.concatenate([g[:, -1] for g, _ in decoded.values()]))) + 100
    for lang, (g, n) in decoded.items():
        model.names.append(lang)
        model.models.append(KneserNey(g, n, alphabet))
    return _calibrate(rows, model, params)


def _calibrate(rows: DataFrame, model: Model, params: Params) -> Model:
    """Limits of rejection and sharpness of the score from the rows kept out of the counts."""
    bound = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in small_slices(batches):
            cost, n = bound.value.entropies(batch.column("text").to_pylist())
            own = np.array([bound.value.names.index(x) if x in bound.value.names else -1 for x in batch.column("lang").to_pylist()], int)
            ok = (own >= 0) & (n >= 20)
            mine = cost[np.arange(len(own)), np.maximum(own, 0)]
            other = np.where(np.arange(cost.shape[1])[None, :] == own[:, None], np.inf, cost).min(1) if cost.shape[1] > 1 else mine + 1
            yield pa.RecordBatch.from_pydict({"own": pa.array(own[ok], pa.int32()), "cost": pa.array(mine[ok]), "gap": pa.array((other - mine)[ok])})

    got = rows.where("kept_out").mapInArrow(run, "own int, cost double, gap double").toPandas()
    limits = []
    for i in range(len(model.names)):
        mine = got.loc[got["own"] == i, "cost"].to_numpy()
        spread = np.subtract(*np.percentile(mine, [75, 25])) if len(mine) >= 8 else 0.0
        limits.append(max(np.median(mine) + params.tolerance * max(spread, 0.1), mine.max() * 1.1) if len(mine) >= 8 else np.inf)
    model.limits = np.array(limits)
    gap = got["gap"].to_numpy()
    model.sharpness = float(4.0 / max(np.median(gap), 1e-3)) if len(gap) else 8.0
    return model


def with_language(docs: DataFrame, model: Model, column: str = "language") -> DataFrame:
    """All columns of ``docs`` and a struct (lang_pred, score, rejected)."""
    bound = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def found(texts: pd.Series) -> pd.DataFrame:
        out = [pd.DataFrame({"lang_pred": lang, "score": share, "rejected": gone}) for lang, share, gone in sliced(texts, bound.value.predict)]
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"lang_pred": [], "score": [], "rejected": []})

    return docs.withColumn(column, found(F.col("text").cast("string")))
