"""Language-model scores from a probabilistic suffix tree over bytes.

A text is its tokens, each followed by a space, and an end byte; ASCII capitals
are lowered. The tree's contexts are the bytes before a byte, up to ``depth`` of
them and across words. A context seen ``least`` times is kept if a divergence test
finds that it says something its suffix without the oldest byte does not; no share
of the corpus decides, so the tree grows with the input. The distribution of a
kept context is smoothed by that of its longest kept suffix: each count gives up
a discount, which the suffix shares out. Each byte of a text is scored in the
longest kept suffix of what stands before it.

Counts are of all training documents, values of all documents: the windows of
``depth`` + 1 bytes, summed in the map tasks and then by key, and the tokens, in
tables that grow with the input. The tree is a written table per depth, made from
the one before by a join with the shorter window and sums by context, which has
at most 256 rows; held-out windows go along with a count of 0, so that the deepest
table holds the value of every window. Two things are broadcast, both with a bound
that no input moves: tokens with at least ``frequent`` of all occurrences and
windows with at least ``frequent_windows`` (at most the reciprocals). All others
are joined with the tables, once per document and kind.

Null and empty texts are the end token alone. Without training documents counts
are 0 and every byte is equally likely. Repeated rows are documents each; a null
id counts as the empty text for the fold. Very long texts are read whole.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starloom.llm.common import fold, small_slices, sums_by, text_of, written

SPACE, END = b" ", b"\n"
FLUSH = 400_000
DISCOUNT = 0.5


@dataclass(frozen=True)
class Params:
    depth: int = 5  # a window's bytes fit a positive long up to 6
    least: int = 2
    divergence: float = 1.5
    frequent: float = 1e-6
    frequent_windows: float = 2.5e-7


def tokens_of(text: str) -> list[bytes]:
    """Words of the text; bytes, so only A-Z are lowered and only ASCII white space splits."""
    return text.encode().lower().split()


def _count_tokens(batches):
    """token and its training occurrences; tokens of held-out texts count 0."""
    total: Counter[bytes] = Counter()
    held_out: set[bytes] = set()
    ends = 0

    def packed():
        for w in held_out.difference(total):
            total[w] = 0
        return pa.RecordBatch.from_pydict({"token": pa.array(list(total), pa.binary()), "n": pa.array(list(total.values()), pa.int64())})

    for batch in small_slices(batches):
        for text, held in zip(batch.column("text").to_pylist(), batch.column("held_out").to_pylist(), strict=True):
            if held:
                held_out.update(tokens_of(text))
            else:
                ends += 1
                total.update(tokens_of(text))
        if len(total) + len(held_out) > FLUSH:
            yield packed()
            total.clear()
            held_out.clear()
    total[END] += ends
    yield packed()


def spelled(words: list[bytes]) -> bytes:
    return SPACE.join([*words, END])


def windows(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For every byte a key: itself in the highest place, then the bytes before it; spaces stand before a text.

    With the newest byte on top, what a depth sees is the key without its low bytes. Returns keys and bytes per text.
    """
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    raw = np.frombuffer(b"".join([SPACE * depth + t for t in texts]), np.uint8)
    at = np.arange(size.sum()) + np.repeat((np.arange(len(texts)) + 1) * depth, size)
    key = raw[at].astype(np.int64)
    for d in range(1, depth + 1):
        key <<= 8
        key |= raw[at - d]
    return key, size


def _count_windows(depth: int):
    """Windows with their occurrences in training and in all texts, summed over a task, in several steps if they are many."""

    def run(batches):
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def packed():
            keys, n, times = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*parts, strict=True) if parts else ((), (), ())))
            order = np.argsort(keys)
            keys = keys[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
            summed = [np.add.reduceat(x[order], first) if len(keys) else x for x in (n, times)]
            return pa.RecordBatch.from_arrays([pa.array(keys[first]), *map(pa.array, summed)], names=["gram", "n", "times"])

        for batch in small_slices(batches):
            held = batch.column("held_out").to_pylist()
            texts = batch.column("text").to_pylist()
            for side in (False, True):
                new, times = np.unique(windows([spelled(tokens_of(t)) for t, h in zip(texts, held, strict=True) if h == side], depth)[0], return_counts=True)
                parts.append((new, np.zeros_like(times) if side else times, times))
            if sum(len(part[0]) for part in parts) > 8 * FLUSH:
                yield packed()
                parts.clear()
        yield packed()

    return run


def distinct_of(keys: np.ndarray) -> np.ndarray:
    """The different keys in order: by a sort, as ``np.unique`` of millions of integers hashes them one by one."""
    ordered = np.sort(keys)
    return ordered[np.concatenate([[True], ordered[1:] != ordered[:-1]])] if len(ordered) else ordered


def places_of(distinct: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Index in the sorted ``distinct`` of keys that are all among them: by a hash table, the few that collide by search."""
    if not len(distinct):
        return np.zeros(0, np.int64)
    bits = np.uint64(64 - max(16, int(np.ceil(np.log2(len(distinct)))) + 2))
    slot = lambda x: ((x * np.int64(-7046029254386353131)).view(np.uint64) >> bits).astype(np.int64)
    table = np.zeros(1 << (64 - int(bits)), np.int32)
    table[slot(distinct)] = np.arange(len(distinct), dtype=np.int32)
    at = table[slot(keys)]
    other = np.flatnonzero(distinct[at] != keys)
    at[other] = np.searchsorted(distinct, keys[other])
    return at


@dataclass
class Model:
    tokens: DataFrame  # token, n: every distinct token, 0 where only held-out texts have it
    windows: DataFrame  # gram, n, times, value: every distinct window, its log10 probability of the newest byte
    contexts: DataFrame  # depth, context, total: what the tree keeps
    train_tokens: int
    kinds: int


def fit(docs: DataFrame, params: Params = Params()) -> Model:
    """``docs``: text and held_out; held-out rows only add tokens and windows whose counts are 0."""
    rows = docs.select("text", "held_out")
    tokens = written(rows.mapInArrow(_count_tokens, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n")), "tree-tokens")
    size = tokens.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count_if(F.col("n") > 0).alias("v")).first()
    full = rows.mapInArrow(_count_windows(params.depth), "gram long, n long, times long").groupBy("gram").agg(F.sum("n").alias("n"), F.sum("times").alias("times"))
    full = written(full, "tree-windows")
    whole = full.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    levels = [_root(full, whole, params)]
    for d in range(1, params.depth + 1):
        levels.append(written(_deeper(full, levels[-1], d, params), f"tree-depth-{d}"))
    contexts = levels[0].select(F.lit(0).alias("depth"), F.lit(0).cast("long").alias("context"), "total").limit(0)
    for d, level in enumerate(levels[1:], 1):
        contexts = contexts.unionByName(level.where("kept").select(F.lit(d).alias("depth"), "context", "total").distinct())
    values = levels[-1].select("gram", "n", "times", F.log10("p").alias("value"))
    return Model(tokens, values, contexts, size["n"], size["v"])


def _counts(full: DataFrame, depth: int, params: Params) -> DataFrame:
    """Counts of the newest byte and the ``depth`` bytes before it."""
    short = F.shiftright("gram", 8 * (params.depth - depth)).alias("gram")
    return full.groupBy(short).agg(F.sum("n").alias("n"), F.sum("times").alias("times"))


def _root(full: DataFrame, whole: int, params: Params) -> DataFrame:
    """All bytes without a context, half a count added to each."""
    bytes_ = _counts(full, 0, params)
    return bytes_.select("gram", "n", F.lit(whole).cast("long").alias("total"), ((F.col("n") + 0.5) / (whole + 0.5 * 256)).alias("p"))


def _deeper(full: DataFrame, shorter: DataFrame, depth: int, params: Params) -> DataFrame:
    """gram, n, times, context, total, kept, p of every window of a depth; ``shorter``: the level above."""
    context = F.col("gram").bitwiseAND(F.lit((1 << 8 * depth) - 1).cast("long"))
    level = _counts(full, depth, params).select("gram", "n", "times", context.alias("context"), F.shiftright("gram", 8).alias("up"))
    above = shorter.select(F.col("gram").alias("up"), F.col("n").alias("up_n"), F.col("total").alias("up_total"), F.col("p").alias("up_p"))
    of_context = Window.partitionBy("context")  # at most 256 rows, one per byte
    # total x Kullback-Leibler divergence from the suffix's distribution, in nats.
    part = F.when(F.col("n") > 0, F.col("n") * F.log(F.col("n") * F.col("up_total") / F.greatest("up_n", F.lit(1))))
    rows = level.join(above, "up").select(
        "gram", "n", "times", "context", "up_p", F.sum("n").over(of_context).alias("total"),
        F.count_if(F.col("n") > 0).over(of_context).alias("kinds"), F.coalesce(F.sum(part).over(of_context), F.lit(0.0)).alias("parts"))
    some = F.greatest("total", F.lit(1))
    gain = F.col("parts") - some * F.log(some)
    rows = rows.withColumn("kept", (F.col("total") >= params.least) & (gain >= params.divergence * F.col("kinds")))
    own = (F.greatest(F.col("n") - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col("kinds") * F.col("up_p")) / some
    return rows.select("gram", "n", "times", "context", "total", "kept", F.when(F.col("kept"), own).otherwise(F.col("up_p")).alias("p"))


def _lists(size: np.ndarray, names: list[str], columns: list[pa.Array]) -> pa.Array:
    """Lists of structs from rows in order and the number of rows in each."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.StructArray.from_arrays(columns, names=names))


def _known_windows(texts: list[bytes], depth: int, hot: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Sum of the values of a text's broadcast windows, and all its others with their occurrences."""
    keys, size = windows(texts, depth)
    distinct = distinct_of(keys)
    place = np.searchsorted(hot, distinct)
    place[place == len(hot)] = 0
    found = hot[place] == distinct if len(hot) else np.zeros(len(distinct), bool)
    worth = np.zeros(len(distinct))
    worth[found] = value[place[found]]
    at = places_of(distinct, keys)
    rest = np.flatnonzero(~found[at])
    owner = np.repeat(np.arange(len(texts)), size)[rest]
    pair, times = np.unique(owner * len(distinct) + at[rest], return_counts=True)
    per_text = np.bincount(pair // max(len(distinct), 1), minlength=len(texts))
    return sums_by(worth[at], size), _lists(per_text, ["gram", "times"], [pa.array(distinct[pair % max(len(distinct), 1)]), pa.array(times, pa.int32())])


def _score_documents(bound, depth: int):
    def run(batches):
        from pyspark import TaskContext

        row, (grams, values, hot) = TaskContext.get().partitionId() << 40, bound.value
        for batch in small_slices(batches):
            split = [tokens_of(t) for t in batch.column("text").to_pylist()]
            score, rare = _known_windows([spelled(words) for words in split], depth, grams, values)
            known, base, n, token, times, size = [], [], [], [], [], []
            for words in split:
                words.append(END)
                k, b, before = 0, 0.0, len(token)
                for w, t in Counter(words).items():
                    v = hot.get(w)
                    if v is None:
                        token.append(w)
                        times.append(t)
                    else:
                        k += t
                        b += t * v
                known.append(k)
                base.append(b)
                n.append(len(words))
                size.append(len(token) - before)
            rows = np.arange(row, row + len(split))
            row += len(split)
            rest = _lists(np.array(size, np.int64), ["token", "times"], [pa.array(token, pa.binary()), pa.array(times, pa.int32())])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(rows), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(score), rest, rare],
                names=["doc_id", "held_out", "row", "n_tokens", "known", "base", "likely", "rest", "rare"])

    return run


_SCORED = "doc_id long, held_out boolean, row long, n_tokens long, known long, base double, likely double, rest array<struct<token:binary,times:int>>, rare array<struct<gram:long,times:int>>"


def score(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row; ``docs``: doc_id, text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), (fold("doc_id", 10) == 0).alias("held_out"))
    model = fit(rows, params)
    valued = model.tokens.withColumn("value", F.log10((F.col("n") + 0.1) / (F.lit(float(model.train_tokens)) + 0.1 * (model.kinds + 1))))
    is_common = (F.col("n") > 0) & (F.col("n") >= params.frequent * model.train_tokens)
    common = valued.where(is_common).select("token", "value").toPandas()  # at most 1 / frequent rows
    common = dict(zip(map(bytes, common["token"]), common["value"].tolist(), strict=True))
    whole = model.windows.agg(F.coalesce(F.sum("times"), F.lit(0))).first()[0]
    is_hot = F.col("times") >= params.frequent_windows * whole
    hot = model.windows.where(is_hot).select("gram", "value").toPandas().sort_values("gram")  # at most 1 / frequent_windows rows
    bound = docs.sparkSession.sparkContext.broadcast((hot["gram"].to_numpy(np.int64), hot["value"].to_numpy(float), common))
    part = written(rows.mapInArrow(_score_documents(bound, params.depth), _SCORED), "tree-documents")
    each = part.select("row", F.explode("rest").alias("t")).select("row", "t.token", "t.times").join(valued.where(~is_common), "token")
    rare = part.select("row", F.explode("rare").alias("t")).select("row", "t.gram", "t.times").join(model.windows.where(~is_hot).select("gram", "value"), "gram")
    more = each.select("row", F.when(F.col("n") > 0, F.col("times")).otherwise(0).alias("k"), (F.col("times") * F.col("value")).alias("b"), F.lit(0.0).alias("s"))
    more = more.unionByName(rare.select("row", F.lit(0).alias("k"), F.lit(0.0).alias("b"), (F.col("times") * F.col("value")).alias("s")))
    more = more.groupBy("row").agg(F.sum("k").alias("more_known"), F.sum("b").alias("more_base"), F.sum("s").alias("more_likely"))
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return part.drop("rest", "rare").join(more, "row", "left").select(
        "doc_id", "held_out", "n_tokens", plus("known", "more_known").cast("long").alias("n_known"), F.lit(model.train_tokens).cast("long").alias("train_tokens"),
        plus("base", "more_base").alias("base_score"), plus("likely", "more_likely").alias("score"))
