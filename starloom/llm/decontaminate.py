"""Benchmark decontamination by spaced seeds.

Texts are read as words (letters and digits, lower case). A document is contaminated
by an item if some stretch of aligned words of both holds at least ``least`` words
(all of a shorter item) of which ``agree`` are equal. Masks of seven positions in at
most thirteen words are hashed at every place of items and documents, and joined.
A stretch of 26 words or more splits into parts of 13 to 25 of which one has the same
share of equal words, and the six masks have a hit in every stretch of 13 to 25 words
with a fifth of them substituted, wherever those lie; so no stretch that counts is
without a hit. Every diagonal with a hit is then searched for such a stretch.

Before the join, document windows are looked up in a bit table of the test hashes
whose size is fixed; it only spares rows, the join decides. Null and empty texts
have no window. Items shorter than a window are matched whole, by masks of their
own length: four classes of positions, of which any two substitutions leave two
whole. Equal documents are compared once, and equal items too: an item's row
names the smallest id of its text. Very long texts are read whole.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.llm.common import bit_table, encode_words, in_table, mixed, small_slices, text_key, text_of, written

WORD = re.compile(r"[^\W_]+")
SPAN, AGREE = 13, 0.8  # what the masks cover; a test holds them against every pattern of substitutions
MASKS = tuple(tuple(i for i, c in enumerate(shape) if c == "1") for shape in (
    "11011111", "11010100111", "1110010010011", "11100011101", "1110110000101", "10101110011"))


@dataclass(frozen=True)
class Params:
    least: int = 13
    agree: float = 0.8
    mismatch_cost: int = 3


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word of the texts, and words per text."""
    words, codes, counts = encode_words([WORD.findall(t.lower()) for t in texts])
    h = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))
    return h[codes] if len(codes) else np.zeros(0, np.uint64), counts


@cache
def masks(length: int) -> tuple[tuple[int, ...], ...]:
    """Positions looked at in windows of ``length`` words; of a shorter item a fifth may be substituted."""
    if length >= SPAN:
        return MASKS
    if length < 5:
        return (tuple(range(length)),)
    if length < 10:
        return tuple(tuple(i for i in range(length) if i % 3 != r) for r in range(3))
    return tuple(tuple(i for i in range(length) if i % 4 in two) for two in combinations(range(4), 2))


def seeds(h: np.ndarray, length: int = SPAN - 1) -> list[np.ndarray]:
    """Hash of every place of each mask for windows of ``length`` words."""
    out = []
    with np.errstate(over="ignore"):
        for k, mask in enumerate(masks(length)):
            n = max(0, len(h) - mask[-1])
            total = np.full(n, (k + 1) * 1_000_003 + length, np.uint64)
            for i in mask:
                total += h[i:n + i] * (mixed(np.array([i + 97 * k], np.uint64))[0] | np.uint64(1))
            out.append(mixed(total))
    return out


def item_table(benchmark: DataFrame) -> DataFrame:
    """item_id (smallest of equal word sequences) and words (hashes as longs)."""

    def run(batches):
        for batch in small_slices(batches):
            h, counts = word_hashes(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_pydict({"item_id": batch.column("item_id"), "words": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(h.view(np.int64)))})

    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_of().alias("text")).mapInArrow(run, "item_id long, words array<long>")
    return written(rows.where(F.size("words") > 0).groupBy("words").agg(F.min("item_id").alias("item_id")).select("item_id", "words"), "benchmark-items")


def _item_seeds(batches):
    for batch in batches:
        ids, hashes, at = [], [], []
        for item, words in zip(batch.column("item_id").to_pylist(), batch.column("words"), strict=True):
            h = np.asarray(words.values.to_numpy(), np.int64).view(np.uint64)
            for s in seeds(h, min(SPAN, len(h))):
                ids += [item] * len(s)
                hashes.append(s)
                at.append(np.arange(len(s)))
        yield pa.RecordBatch.from_pydict({
            "item_id": pa.array(ids, pa.int64()), "seed": pa.array((np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)).view(np.int64)),
            "item_at": pa.array(np.concatenate(at) if at else np.zeros(0, np.int64), pa.int32())})


def _document_hits(filter_bits, short: list[int]):
    def run(batches):
        table = filter_bits.value
        for batch in small_slices(batches):
            h, counts = word_hashes(batch.column("text").to_pylist())
            ends = np.cumsum(counts)
            row = np.repeat(np.arange(len(counts)), counts)
            found_row, found_seed, found_at = [], [], []
            for length in [*short, SPAN]:
                for mask, s in zip(masks(length), seeds(h, length), strict=True):
                    if not len(s):
                        continue
                    i = np.flatnonzero(in_table(table, s))
                    i = i[i + mask[-1] < ends[row[i]]]  # windows do not reach into the next text
                    found_row.append(row[i])
                    found_seed.append(s[i])
                    found_at.append(i - (ends - counts)[row[i]])
            if not found_row:
                continue
            r, s, at = (np.concatenate(x) for x in (found_row, found_seed, found_at))
            order = np.lexsort((at, r))
            r, s, at = r[order], s[order], at[order]
            some, first = np.unique(r, return_index=True)
            lists = pa.StructArray.from_arrays([pa.array(s.view(np.int64)), pa.array(at.astype(np.int32))], names=["seed", "at"])
            yield pa.RecordBatch.from_pydict({
                "k1": batch.column("k1").take(pa.array(some)), "k2": batch.column("k2").take(pa.array(some)),
                "words": pa.array([h[ends[d] - counts[d]:ends[d]].view(np.int64) for d in some.tolist()], pa.list_(pa.int64())),
                "hits": pa.ListArray.from_arrays(pa.array(np.append(first, len(r)), pa.int32()), lists)})

    return run


def best_overlap(doc: np.ndarray, item: np.ndarray, diagonal: int, params: Params) -> tuple[int, int, int, int] | None:
    """(start in the document, start in the item, words, equal words) of a stretch along a diagonal that counts, if there is one.

    ``diagonal``: document position minus item position. Taken is the stretch that
    maximises equal words minus ``mismatch_cost`` times differing ones; if that one
    doesn't count, the longest of which ``agree`` are equal.
    """
    low, high = max(0, -diagonal), min(len(item), len(doc) - diagonal)
    if high <= low:
        return None
    same = item[low:high] == doc[low + diagonal:high + diagonal]
    equal = np.concatenate([[0], np.cumsum(same)])
    places = np.arange(len(equal))

    def counts(start: int, stop: int) -> bool:
        return stop - start >= min(params.least, len(item)) and equal[stop] - equal[start] >= params.agree * (stop - start)

    total = equal - params.mismatch_cost * (places - equal)
    stop = int(np.argmax(total - np.minimum.accumulate(total)))
    start = int(np.argmin(total[:stop + 1]))
    if not counts(start, stop):
        share = equal - params.agree * places
        first = np.searchsorted(-np.minimum.accumulate(share), -share - 1e-9)  # where the longest stretch up to each place starts
        stop = int(np.argmax(places - first))
        start = int(first[stop])
    return (low + start + diagonal, low + start, stop - start, int(equal[stop] - equal[start])) if counts(start, stop) else None


def _verify(params: Params):
    def run(batches):
        for batch in batches:
            out = []
            for k1, k2, item_id, doc, item, diagonals in zip(*(batch.column(c) for c in ("k1", "k2", "item_id", "words", "item_words", "diagonals")), strict=True):
                a, b = (np.asarray(x.values.to_numpy(), np.int64) for x in (doc, item))
                found = [x for d in diagonals.as_py() if (x := best_overlap(a, b, d, params))]
                if found:
                    best = max(found, key=lambda x: (x[3] - params.mismatch_cost * (x[2] - x[3]), -x[0]))
                    out.append((k1.as_py(), k2.as_py(), item_id.as_py(), *best, len(b)))
            columns = list(zip(*out, strict=True)) if out else [[]] * 8
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=["k1", "k2", "item_id", "doc_start", "item_start", "span", "equal_words", "item_words"])

    return run


def contaminated_texts(docs: DataFrame, benchmark: DataFrame, params: Params = Params()) -> DataFrame:
    """(k1, k2) of contaminated texts, with item_id and the best overlap: one row per text and item."""
    if params.least < SPAN or params.agree < AGREE:
        raise ValueError(f"the masks cover stretches of {SPAN} words and more of which {AGREE} are equal")
    items = item_table(benchmark)
    item_seeds = written(items.mapInArrow(_item_seeds, "item_id long, seed long, item_at int"), "benchmark-seeds")
    short = sorted(r["n"] for r in items.where(F.size("words") < SPAN).select(F.size("words").alias("n")).distinct().collect())  # at most SPAN - 1 lengths
    bits = docs.sparkSession.sparkContext.broadcast(bit_table(item_seeds))
    rows = docs.select(*text_key(), text_of().alias("text"))
    hit = rows.mapInArrow(_document_hits(bits, short), "k1 long, k2 long, words array<long>, hits array<struct<seed:long,at:int>>")
    hit = written(hit, "benchmark-hits")
    texts = hit.dropDuplicates(["k1", "k2"])
    on = texts.select("k1", "k2", F.explode("hits").alias("hit")).select("k1", "k2", "hit.seed", "hit.at").join(item_seeds, "seed")
    pairs = on.groupBy("k1", "k2", "item_id").agg(F.collect_set(F.col("at") - F.col("item_at")).alias("diagonals"))
    full = pairs.join(texts.select("k1", "k2", "words"), ["k1", "k2"]).join(items.withColumnRenamed("words", "item_words"), "item_id")
    return full.select("k1", "k2", "item_id", "words", "item_words", "diagonals").mapInArrow(
        _verify(params), "k1 long, k2 long, item_id long, doc_start int, item_start int, span int, equal_words int, item_words int")


def contamination(docs: DataFrame, benchmark: DataFrame, params: Params = Params()) -> DataFrame:
    """doc_id, item_id and the overlap: one row for each contaminated document and item."""
    found = written(contaminated_texts(docs, benchmark, params), "benchmark-found")
    return docs.select("doc_id", *text_key()).join(found, ["k1", "k2"]).select("doc_id", "item_id", "doc_start", "item_start", "span", "equal_words", "item_words")


def clean(docs: DataFrame, benchmark: DataFrame, params: Params = Params()) -> DataFrame:
    """The documents no item contaminates, all their columns."""
    found = written(contaminated_texts(docs, benchmark, params).select("k1", "k2").distinct(), "benchmark-found")
    keyed = docs.withColumns({"_k1": text_key()[0], "_k2": text_key()[1]})
    return keyed.join(found, (F.col("_k1") == F.col("k1")) & (F.col("_k2") == F.col("k2")), "left_anti").drop("_k1", "_k2")
