"""Reversible line deduplication: sharded cuckoo filters before exact reference counts.

An index holds three written tables. ``refs`` is a signed log: a row per document
and line key with the number of lines, negated when the document is taken out.
``filters`` has a stack of cuckoo filters per shard of the keys, over the keys that
any document holds. ``counts`` is the exact table of the repeated keys: references,
smallest and greatest document.

``insert`` sends the keys that each task saw, one row per key and batch of rows, to
their shards. There they pass the filter: a key that it doesn't know is put in and
belongs to one document so far; only keys it knows are counted exactly, from the
shard's rows and, where the filter was there before, from the log. A filter may take
a key for another, which the exact count settles; it never forgets one. ``delete``
negates the log rows of documents, counts their keys anew and takes keys that nobody
holds out of the filters. So inserting and deleting in any order leaves what the
documents that remain would give by themselves. Every call writes new tables and
returns a new index; the old one stays whole if an executor or the driver is lost.

A key is a line without white space ``[\\x20\\x09-\\x0D]`` at its ends, A-Z lowered,
taken as a 128-bit hash; shorter ones than ``least`` code points are never dropped.
A line whose key two documents hold is dropped from all but the smallest doc_id.

A hot line is one row per task and batch before it moves; documents of the hottest
keys (each above a thousandth of all references, so fewer than a thousand keys) are
found by a broadcast of those keys, all others by a join. Null and empty texts are
one empty line. Rows of equal doc_id are one document; null ids are one document
after all others. Long texts are cut into lines, not gathered. Other columns are
not read, so their names cannot clash. An empty table gives an empty index.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.llm.common import mixed, small_slices, text_of, written

LAST_ID = (1 << 63) - 1  # stands for a null id
SPACE = " \t\n\x0b\x0c\r"
SLOTS = 4  # fingerprints of 16 bits in a bucket
FULL = 0.8  # a filter fuller than this gets another one beside it
STREAMED = 1 << 16  # rows that pass a filter at once
HOT_SHARE = 1000
ROWS_PER_SHARD = 1 << 18
LEAST_SHARDS = 64

_REFS = "shard int, k1 long, k2 long, doc_id long, n long"
_SEEN = "shard int, k1 long, k2 long, refs long, lo long, hi long"
_OUT = "kind string, shard int, k1 long, k2 long, refs long, lo long, hi long, level int, held long, cells binary"
_FILTERS = "shard int, level int, held long, cells binary"


class CuckooFilter:
    """Set of 64-bit hashes as 16-bit fingerprints in two possible buckets each; vectorised.

    The caller puts a hash in once and takes out only what was put in. ``add`` returns
    the hashes that found no room.
    """

    def __init__(self, cells: np.ndarray, held: int = 0):
        self.cells, self.held = cells.reshape(-1, SLOTS), held

    @classmethod
    def sized(cls, n: int) -> "CuckooFilter":
        buckets = 1 << max(4, int(np.ceil(np.log2(max(1, n) / (SLOTS * FULL)))))
        return cls(np.zeros(buckets * SLOTS, np.uint16))

    @property
    def room(self) -> int:
        return max(0, int(self.cells.size * FULL) - self.held)

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = mixed(hashes.view(np.uint64), 11)
        print_ = np.maximum((h >> np.uint64(48)).astype(np.uint16), 1)
        a = (h & np.uint64(len(self.cells) - 1)).astype(np.int64)
        return print_, a, self._other(print_, a)

    def _other(self, print_: np.ndarray, place: np.ndarray) -> np.ndarray:
        return place ^ (mixed(print_.astype(np.uint64), 12) & np.uint64(len(self.cells) - 1)).astype(np.int64)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        print_, a, b = self._places(hashes)
        return (self.cells[a] == print_[:, None]).any(1) | (self.cells[b] == print_[:, None]).any(1)

    def _put(self, print_: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Fill free slots of the buckets; tells which fingerprints found one."""
        order = np.argsort(place, kind="stable")
        at = place[order]
        first = np.searchsorted(at, at, side="left")
        rank = np.arange(len(at)) - first
        taken = self.cells[at] != 0
        fits = rank < SLOTS - taken.sum(1)
        slot = np.argsort(taken, axis=1, kind="stable")[fits, rank[fits]]
        self.cells[at[fits], slot] = print_[order[fits]]
        self.held += int(fits.sum())
        done = np.zeros(len(place), bool)
        done[order[fits]] = True
        return done

    def add(self, hashes: np.ndarray, rounds: int = 200) -> np.ndarray:
        if not len(hashes):
            return hashes
        print_, a, b = self._places(hashes)
        left = np.flatnonzero(~self._put(print_, a))
        left = left[~self._put(print_[left], b[left])]
        if not len(left):
            return hashes[:0]
        before, rng = self.cells.copy(), np.random.default_rng(len(hashes))
        fp, at, held = print_[left], b[left], self.held
        for _ in range(rounds):
            _, one = np.unique(at, return_index=True)  # one fingerprint of a bucket moves at a time
            slot = rng.integers(0, SLOTS, len(one))
            out = self.cells[at[one], slot].copy()
            self.cells[at[one], slot] = fp[one]
            fp[one] = out
            at[one] = self._other(out, at[one])
            stay = ~self._put(fp, at)
            fp, at = fp[stay], at[stay]
            if not len(fp):
                return hashes[:0]
        self.cells, self.held = before, held  # what was put in before the moves stays
        return hashes[left]

    def remove(self, hashes: np.ndarray) -> np.ndarray:
        """Take one copy out for each hash; tells for which there was one."""
        print_, a, b = self._places(hashes)
        done = np.zeros(len(hashes), bool)
        for place in (a, b):
            for slot in range(SLOTS):
                open_ = np.flatnonzero(~done & (self.cells[place, slot] == print_))
                _, one = np.unique(place[open_], return_index=True)
                hit = open_[one]
                self.cells[place[hit], slot] = 0
                done[hit] = True
        # Equal fingerprints of one bucket that met in a slot look once more, one by one.
        for i in np.flatnonzero(~done).tolist():
            for place in (a[i], b[i]):
                same = np.flatnonzero(self.cells[place] == print_[i])
                if len(same):
                    self.cells[place, same[0]] = 0
                    done[i] = True
                    break
        self.held -= int(done.sum())
        return done


class FilterStack:
    """Filters of one shard; when the last is full the next is as large as all before, so there are few."""

    def __init__(self, filters: list[CuckooFilter]):
        self.filters = filters

    @classmethod
    def read(cls, frame: pd.DataFrame) -> "FilterStack":
        rows = frame.sort_values("level")
        return cls([CuckooFilter(np.frombuffer(c, np.uint16).copy(), int(h)) for c, h in zip(rows["cells"], rows["held"])])

    def has(self, hashes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(hashes), bool)
        for f in self.filters:
            out |= f.has(hashes)
        return out

    def add(self, hashes: np.ndarray, expected: int = 0) -> None:
        while len(hashes):
            if not self.filters or not self.filters[-1].room:
                self.filters.append(CuckooFilter.sized(max(len(hashes), expected, sum(f.cells.size for f in self.filters))))
            last = self.filters[-1]
            n = min(len(hashes), last.room)
            refused = last.add(hashes[:n])
            if len(refused):
                self.filters.append(CuckooFilter.sized(max(len(hashes), sum(f.cells.size for f in self.filters))))
            hashes = np.concatenate([refused, hashes[n:]])

    def remove(self, hashes: np.ndarray) -> None:
        for f in self.filters:
            hashes = hashes[~f.remove(hashes)]

    def rows(self, shard: int) -> pd.DataFrame:
        return pd.DataFrame({"shard": shard, "level": range(len(self.filters)), "held": [f.held for f in self.filters], "cells": [f.cells.tobytes() for f in self.filters]})


@dataclass(frozen=True)
class LineIndex:
    """``refs``, ``filters`` and ``counts`` as told above, with the rule of the keys."""

    refs: DataFrame
    filters: DataFrame
    counts: DataFrame
    shards: int
    least: int = 10


def _lines(texts: pa.Array, least: int) -> tuple[pa.Array, np.ndarray, np.ndarray, list[bytes]]:
    """All lines, lines per text, the key code of each line (-1: too short), and the hash of each code."""
    split = pc.split_pattern(texts, "\n")
    flat = split.flatten()
    keys = pc.ascii_lower(pc.ascii_trim(flat, characters=SPACE))
    long_ = pc.greater_equal(pc.utf8_length(keys), least)
    coded = pc.if_else(long_, keys, pa.scalar(None, keys.type)).dictionary_encode()
    codes = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    hashes = [xxhash.xxh3_128_digest(k) for k in coded.dictionary.cast(pa.binary()).to_pylist()]
    return flat, split.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), codes, hashes


def _id() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("doc_id")


def line_refs(docs: DataFrame, shards: int | None = None, least: int = 10) -> DataFrame:
    """shard, k1, k2, doc_id, n: the line keys of each document row with their number of lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_slices(batches):
            _, counts, codes, hashes = _lines(batch.column("text"), least)
            owner = np.repeat(np.arange(len(counts)), counts)
            pair, n = np.unique((owner << 32 | codes)[codes >= 0], return_counts=True)
            k = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)[pair & 0xFFFFFFFF]
            ids = batch.column("doc_id").to_numpy()[pair >> 32]
            yield pa.RecordBatch.from_pydict({"shard": pa.array(np.zeros(len(n), np.int32)), "k1": k[:, 0].copy(), "k2": k[:, 1].copy(), "doc_id": ids, "n": n.astype(np.int64)})

    rows = docs.select(_id(), text_of().alias("text")).mapInArrow(run, _REFS)
    return rows if shards is None else rows.withColumn("shard", _shard(shards))


def _shard(shards: int) -> Column:
    return F.pmod(F.shiftright("k2", 8), F.lit(shards)).cast("int")


def _sighted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per key of a batch: references, smallest and greatest document."""
    for batch in batches:
        t = pa.Table.from_batches([batch]).group_by(["shard", "k1", "k2"]).aggregate([("doc_id", "count"), ("doc_id", "min"), ("doc_id", "max")])
        t = t.select(["shard", "k1", "k2", "doc_id_count", "doc_id_min", "doc_id_max"]).rename_columns(["shard", "k1", "k2", "refs", "lo", "hi"])
        yield from t.to_batches()


def _through_filter(key: tuple, seen: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    """A shard's sightings pass its filters; keys known to them are counted (from here) or asked for (from the log)."""
    shard = int(key[0])
    old = FilterStack.read(filters)
    k1 = seen["k1"].to_numpy(np.int64)
    asked = np.unique(k1[old.has(k1)])
    fresh = ~np.isin(k1, asked)
    new, stack = FilterStack([]), k1[fresh]
    expected = len(np.unique(stack))
    known, met = [stack[:0]], [stack[:0]]
    for at in range(0, len(stack), STREAMED):
        part, times = np.unique(stack[at:at + STREAMED], return_counts=True)
        hit = new.has(part)
        new.add(part[~hit], expected)
        known.append(part[~hit])
        met += [part[hit], part[times > 1]]
    several = seen.loc[fresh & (seen["lo"] != seen["hi"]).to_numpy(), "k1"].to_numpy(np.int64)
    again = np.unique(np.concatenate([*met, several]))
    mistaken = np.setdiff1d(again, np.concatenate(known))  # taken for another key: not in the filter itself yet
    put = np.concatenate([np.concatenate(known), mistaken])
    old.add(put) if old.filters else new.add(mistaken)
    exact = seen[fresh & np.isin(k1, again)].groupby(["k1", "k2"], as_index=False).agg(refs=("refs", "sum"), lo=("lo", "min"), hi=("hi", "max"))
    ask = seen.loc[np.isin(k1, asked), ["k1", "k2"]].drop_duplicates()
    kept = (old if old.filters else new).rows(shard)
    parts = (("count", exact[exact["lo"] != exact["hi"]]), ("ask", ask), ("filter", kept))
    return pd.concat([_told(kind, shard, part) for kind, part in parts if len(part)] or [_told("ask", shard, ask)], ignore_index=True)


def _told(kind: str, shard: int, part: pd.DataFrame) -> pd.DataFrame:
    """The rows in the columns of ``_OUT``; whole numbers stay whole beside nulls."""
    whole = {c: pd.array(part[c], dtype="Int64") if c in part else pd.array([pd.NA] * len(part), dtype="Int64") for c in ("k1", "k2", "refs", "lo", "hi", "level", "held")}
    return pd.DataFrame({"kind": kind, "shard": shard, **whole, "cells": list(part["cells"]) if "cells" in part else [None] * len(part)})


def _change_filter(add: bool):
    def run(key: tuple, keys: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
        stack = FilterStack.read(filters)
        hashes = np.unique(keys["k1"].to_numpy(np.int64))
        stack.add(hashes) if add else stack.remove(hashes)
        return stack.rows(int(key[0]))

    return run


def _changed_filters(filters: DataFrame, keys: DataFrame, add: bool) -> DataFrame:
    changed = keys.select(F.col("shard").alias("of"), F.col("k1").alias("k1")).groupBy("of").cogroup(filters.groupBy("shard")).applyInPandas(_change_filter(add), _FILTERS)
    return written(changed, "lines-filters")


def _recounted(refs: DataFrame, keys: DataFrame) -> DataFrame:
    """Exact references of the keys, documents that still hold them only."""
    held = refs.join(keys.select("k1", "k2").distinct(), ["k1", "k2"], "left_semi").groupBy("shard", "k1", "k2", "doc_id").agg(F.sum("n").alias("n")).where("n > 0")
    return held.groupBy("shard", "k1", "k2").agg(F.count("*").alias("refs"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))


def empty_index(spark: SparkSession, shards: int = LEAST_SHARDS, least: int = 10) -> LineIndex:
    none = lambda schema: spark.createDataFrame([], schema)
    return LineIndex(none(_REFS), none(_FILTERS), none(_SEEN), shards, least)


def build_index(docs: DataFrame, least: int = 10) -> LineIndex:
    """An index of all documents, its shards sized by their lines."""
    refs = written(line_refs(docs, least=least), "lines-refs")
    shards, n = LEAST_SHARDS, refs.count()
    while shards * ROWS_PER_SHARD < n:
        shards *= 2
    return _insert(empty_index(docs.sparkSession, shards, least), refs.withColumn("shard", _shard(shards)), False)


def insert(index: LineIndex, docs: DataFrame) -> LineIndex:
    """The index with the documents, whose ids it must not hold yet."""
    return _insert(index, written(line_refs(docs, index.shards, index.least), "lines-refs"), True)


def _insert(index: LineIndex, refs: DataFrame, grown: bool) -> LineIndex:
    log = index.refs.unionByName(refs) if grown else refs
    seen = refs.select("shard", "k1", "k2", "doc_id").mapInArrow(_sighted, _SEEN)
    out = written(seen.groupBy("shard").cogroup(index.filters.groupBy("shard")).applyInPandas(_through_filter, _OUT), "lines-passed")
    filters, counted = out.where("kind = 'filter'").select("shard", "level", "held", "cells"), out.where("kind = 'count'").select("shard", "k1", "k2", "refs", "lo", "hi")
    if not grown:
        return replace(index, refs=log, filters=filters, counts=counted)
    # What filters that were there before know is counted from the log; they may have taken it for another key.
    asked = out.where("kind = 'ask'").select("shard", "k1", "k2")
    present = index.refs.join(asked.select("k1").distinct(), "k1", "left_semi").groupBy("shard", "k1", "k2", "doc_id").agg(F.sum("n").alias("n")).where("n > 0")
    mistaken = asked.join(present.select("k1").distinct(), "k1", "left_anti")
    kept = index.counts.join(asked, ["shard", "k1", "k2"], "left_anti")
    counts = kept.unionByName(counted).unionByName(_recounted(log, asked).where("lo <> hi"))
    return replace(index, refs=log, filters=_changed_filters(filters, mistaken, True), counts=written(counts, "lines-counts"))


def delete(index: LineIndex, ids: DataFrame) -> LineIndex:
    """The index without the documents of ``ids`` (doc_id); unknown ids change nothing."""
    held = index.refs.join(ids.select(_id()).distinct(), "doc_id", "left_semi").groupBy("shard", "k1", "k2", "doc_id").agg(F.sum("n").alias("n")).where("n > 0")
    gone = written(held.select("shard", "k1", "k2", "doc_id", (-F.col("n")).alias("n")), "lines-gone")
    log, keys = index.refs.unionByName(gone), gone.select("shard", "k1", "k2").distinct()
    now = written(_recounted(log, keys), "lines-recounted")
    # A filter knows first halves of hashes: one goes only when no key with it is left.
    alive = log.join(keys.select("k1").distinct(), "k1", "left_semi").groupBy("k1", "k2", "doc_id").agg(F.sum("n").alias("n")).where("n > 0").select("k1").distinct()
    counts = index.counts.join(keys, ["shard", "k1", "k2"], "left_anti").unionByName(now.where("lo <> hi"))
    return replace(index, refs=log, filters=_changed_filters(index.filters, keys.join(alive, "k1", "left_anti"), False), counts=written(counts, "lines-counts"))


def dropped_keys(index: LineIndex) -> DataFrame:
    """doc_id, k1, k2: line keys that a document loses, as a smaller one holds them."""
    n = index.refs.count()
    pairs = index.refs.select("k1", "k2", "doc_id", "n")
    hot = F.broadcast(index.counts.where(F.col("refs") * HOT_SHARE > n).select("k1", "k2", F.col("lo").alias("_hot")))  # fewer than HOT_SHARE rows
    marked = pairs.join(hot, ["k1", "k2"], "left")
    rest = index.counts.where(F.col("refs") * HOT_SHARE <= n).select("k1", "k2", "lo")
    cold = marked.where("_hot IS NULL").drop("_hot").join(rest, ["k1", "k2"]).where("doc_id <> lo").drop("lo")
    both = marked.where("doc_id <> _hot").drop("_hot").unionByName(cold)
    return both.groupBy("doc_id", "k1", "k2").agg(F.sum("n").alias("n")).where("n > 0").drop("n")


def clean(index: LineIndex, docs: DataFrame) -> DataFrame:
    """doc_id, text without the lines that a smaller document of the index holds, n_lines (before) and n_dropped."""
    least = index.least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_slices(batches):
            flat, counts, codes, hashes = _lines(batch.column("text"), least)
            code_of = {h: c for c, h in enumerate(hashes)}
            owner = np.repeat(np.arange(len(counts)), counts)
            lists = batch.column("dropped")
            held, of = lists.flatten(), np.repeat(np.arange(len(counts)), pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False))
            raw = np.stack([held.field("k1").to_numpy(), held.field("k2").to_numpy()], 1).astype("<i8").tobytes()
            found = np.array([code_of.get(raw[k:k + 16], -1) for k in range(0, len(raw), 16)], np.int64)
            drops = (of << 32 | found)[found >= 0]
            keep = ~np.isin(owner << 32 | codes, drops)
            left = np.bincount(owner[keep], minlength=len(counts))
            ends = pa.array(np.concatenate([[0], np.cumsum(left)]), pa.int32())
            joined = pc.binary_join(pa.ListArray.from_arrays(ends, flat.filter(pa.array(keep))), "\n")
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text": joined, "n_lines": counts, "n_dropped": counts - left})

    lists = dropped_keys(index).groupBy(F.col("doc_id").alias("_id")).agg(F.collect_list(F.struct("k1", "k2")).alias("dropped"))
    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).join(lists, _id() == F.col("_id"), "left")
    return joined.select("doc_id", "text", "dropped").mapInArrow(run, "doc_id long, text string, n_lines long, n_dropped long")
