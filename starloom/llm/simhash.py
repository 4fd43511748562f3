"""SimHash near-duplicates by tiled exact comparison.

A fingerprint has 64 bits for each of its words; the first word sums the XXH64 of
the shingles (seed 42), later words the same hash mixed again. Equal fingerprints
are one item. Items are compared in cells, cells are cut into tiles of bounded
size along the population count, and every pair of tiles whose population counts
can lie within the radius is compared exactly with numpy exclusive-or and bit
counts; the others are skipped. Each task returns a spanning forest of the links
it found, which has the same components as the links.

With ``similarity`` > 0 the fingerprints are of distinct shingles, links are only
candidates as far apart as ``reach`` says for their sizes, and a link counts if the Jaccard similarity of the two shingle sets is
at least that. The forest is then a minimum one: links within ``near`` bits first,
which are rarely refuted, then the others by distance. Where a link of a group of
candidates is refuted, its candidates are compared once more, now with their
shingle sets, so no link is lost to the forest.
Equal fingerprints are taken as equal.

Cells: for a small radius r on one word, the word is cut into r + 2 blocks; two
fingerprints within r bits agree on at least two of them, so there is one cell
for every pair of blocks and their values, and no link is lost. For a wide
radius, where no such cells exist, cells are classes of the shingle count: a link
then also asks that the smaller count is at least ``ratio`` of the larger one, so
only a class and the one above it meet.

Null and empty texts have fingerprint zero and are linked like any other. Repeated
rows and texts share a fingerprint. A null id belongs to its component; the
smallest known id names it, null if there is none. Very long texts are read whole.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starloom.llm.common import bit_table, in_table, mixed, small_slices, text_of, written
from starloom.operators.lineage import components

SEED = 42
HELD_PAIRS = 1_000_000  # pairs kept before they are cut to their spanning forest
BLOCK_ITEMS, BLOCK_SHINGLES = 512, 1 << 18  # of texts whose shingle sets are compared in one task; a longer text is alone


@dataclass(frozen=True)
class Params:
    """Links: at most ``radius`` differing bits of 64 x ``words``; ``ratio`` > 0: cells by shingle count."""

    shingle: int = 3
    words: int = 1
    radius: int = 2
    ratio: float = 0.0
    similarity: float = 0.0
    near: int = 0
    tile: int = 8_192


# Five-word shingles, similarity 0.8; sizes differ by 0.8 at most. ``reach`` gives the candidates' distance
# by the size of the smaller set, ``radius`` is the farthest of them.
# Large tiles: each pair of tiles adds a forest of its own, whose links are verified.
LOST = 1e-9  # of the pairs that are as similar as asked, at any sizes, at most this share lies beyond ``reach``
SIMILAR = Params(shingle=5, words=4, radius=89, ratio=0.8, similarity=0.8, near=24, tile=32_768)


def differing(n: int, m: int, both: int) -> float:
    """Probability that a bit differs between sets of n and m random hashes with ``both`` in common."""
    def above(left, k, size):  # more than half of ``size`` have the bit, k of the common ones do
        held = [comb(left, a) for a in range(left + 1)]
        return sum(x for a, x in enumerate(held) if 2 * (k + a) > size) / 2**left

    p = 0.0
    for k in range(both + 1):
        a, b = above(n - both, k, n), above(m - both, k, m)
        p += comb(both, k) / 2**both * (a * (1 - b) + b * (1 - a))
    return p


@cache
def reach(similarity: float, bits: int, sizes: int = 64) -> np.ndarray:
    """Farthest distance of candidates by the size of the smaller set; the last one is for all larger sets.

    Sets of that size which are as similar as asked, but not equal, are farther apart
    with probability ``LOST`` at most; -1 where there are none.
    """
    out = np.full(sizes + 1, -1, np.int64)
    for m in range(1, sizes + 1):
        worst = max((differing(n, m, both) for n in range(m, int(m / similarity + 1e-9) + 1) for both in range(m - (n == m), 0, -1) if both >= similarity * (n + m - both)), default=0.0)
        if worst:
            tail, k = 0.0, bits
            while tail + (x := comb(bits, k) * worst**k * (1 - worst) ** (bits - k)) <= LOST:
                tail, k = tail + x, k - 1
            out[m] = k
    out[sizes] = max(out[sizes // 2:])  # the probability falls with the size, up to ties
    return out


def shingle_hashes(text: str, n: int) -> np.ndarray:
    """XXH64 of every run of n words, repeats included; of the whole sequence if it is shorter."""
    words = text.encode().lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= n:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    start = np.concatenate([[0], np.cumsum(size[:-1] + 1)])
    stop = start[n - 1:] + size[n - 1:]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(start.tolist(), stop.tolist(), strict=False)), np.uint64, len(stop))


def fingerprint(h: np.ndarray, words: int) -> np.ndarray:
    """A bit is set where over half of the hashes have it."""
    out = np.zeros(words, np.uint64)
    if not len(h):
        return out
    for w in range(words):
        ones = np.zeros(64, np.int64)
        for start in range(0, len(h), 1 << 16):
            part = h[start:start + (1 << 16)]
            part = mixed(part, w) if w else part
            ones += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        out[w] = np.packbits(2 * ones > len(h)).view(">u8")[0]
    return out


def fingerprints(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """doc_id, fingerprint (hex), shingles (count) of every row."""

    def run(batches):
        for batch in small_slices(batches):
            prints, counts = [], []
            for text in batch.column("text").to_pylist():
                h = shingle_hashes(text, params.shingle)
                h = np.unique(h) if params.similarity else h
                prints.append("".join(f"{x:016x}" for x in fingerprint(h, params.words).tolist()))
                counts.append(len(h))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "fingerprint": pa.array(prints, pa.string()), "shingles": pa.array(counts, pa.int64())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, "doc_id long, fingerprint string, shingles long")


def _limits(params: Params) -> np.ndarray | None:
    return reach(params.similarity, 64 * params.words) if params.similarity else None


def _word(k: int) -> Column:
    """Word k of the hex fingerprint as a signed long."""
    high = F.conv(F.substring("fingerprint", 16 * k + 1, 8), 16, 10).cast("long")
    low = F.conv(F.substring("fingerprint", 16 * k + 9, 8), 16, 10).cast("long")
    return F.shiftleft(high, 32).bitwiseOR(low)


def block_keys(word: Column, radius: int) -> Column:
    """One key for every pair of radius + 2 blocks: which pair, and its bits."""
    parts = radius + 2
    edges = [64 * k // parts for k in range(parts + 1)]
    masks = [sum(1 << b for b in range(edges[k], edges[k + 1])) for k in range(parts)]
    keys = []
    for i, (a, b) in enumerate(combinations(range(parts), 2)):
        mask = masks[a] | masks[b]
        signed = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.struct(F.lit(i).alias("kind"), word.bitwiseAND(F.lit(signed).cast("long")).alias("value")))
    return F.array(*keys)


def _compare(words: int, radius: int, ratio: float, near_radius: int, limits: np.ndarray | None = None):
    """Spanning forest of the links inside a tile or between two tiles."""

    def links(left, right, inner, radius):
        """Yield rows, linked partners and their distances, comparing left row by row with what lies within reach on the right."""
        a, pa_, na = left
        b, pb, nb = right
        low, high = np.searchsorted(pb, pa_ - radius, "left"), np.searchsorted(pb, pa_ + radius, "right")
        for i in range(len(a)):
            s, e = (max(low[i], i + 1), high[i]) if inner else (low[i], high[i])
            if s >= e:
                continue
            d = np.bitwise_count(b[s:e, 0] ^ a[i, 0]).astype(np.int16)
            for w in range(1, words):
                d += np.bitwise_count(b[s:e, w] ^ a[i, w])
            near = np.flatnonzero(d <= radius)
            if ratio and len(near):
                near = near[np.minimum(nb[near + s], na[i]) >= ratio * np.maximum(nb[near + s], na[i])]
            if limits is not None and len(near):
                near = near[d[near] <= limits[np.minimum(np.minimum(nb[near + s], na[i]), len(limits) - 1)]]
            if len(near):
                yield i, near + s, d[near]

    def side(items):
        f = np.frombuffer(bytes.fromhex("".join(x["fingerprint"] for x in items)), ">u8").astype(np.uint64).reshape(-1, words)
        n = np.fromiter((x["shingles"] for x in items), np.int64, len(items))
        p = np.bitwise_count(f).sum(1, dtype=np.int64)
        order = np.argsort(p, kind="stable")
        return (f[order], p[order], n[order]), [items[k]["fingerprint"] for k in order]

    def run(batches):
        for batch in batches:
            u, v = [], []
            for left, right, inner in zip(batch.column("left"), batch.column("right"), batch.column("inner").to_pylist(), strict=True):
                a, names_a = side(left.as_py())
                b, names_b = (a, names_a) if inner else side(right.as_py())
                shift = 0 if inner else len(names_a)
                root = np.arange(len(names_a) + (0 if inner else len(names_b)))

                def find(x):
                    while root[x] != x:
                        root[x] = root[root[x]]
                        x = root[x]
                    return x

                def joined(pairs):
                    for x, y in pairs:
                        a_root, b_root = find(x), find(y)
                        if a_root != b_root:
                            root[max(a_root, b_root)] = min(a_root, b_root)
                            yield x, y

                def emit(pairs):
                    for x, y in pairs:
                        u.append(names_a[x])
                        v.append(names_b[y - shift])

                first = near_radius or radius
                for i, near, _ in links(a, b, inner, first):
                    emit(joined((i, j + shift) for j in near[root[near + shift] != root[i]].tolist()))
                if first < radius:  # what is left, nearest links first
                    start = np.fromiter(map(find, range(len(root))), np.int64, len(root))
                    held: list[tuple[np.ndarray, ...]] = []

                    def forest():
                        nonlocal root
                        x, y, d = (np.concatenate(c) for c in zip(*held, strict=True))
                        root = start.copy()
                        order = np.argsort(d, kind="stable")
                        x, y, d = x[order], y[order], d[order]
                        kept = dict.fromkeys(joined(zip(x.tolist(), y.tolist(), strict=True)))
                        mine = np.fromiter(((p, q) in kept for p, q in zip(x.tolist(), y.tolist(), strict=True)), bool, len(x))
                        held[:] = [(x[mine], y[mine], d[mine])]
                        return kept

                    for i, near, far in links(a, b, inner, radius):
                        other = start[near + shift] != start[i]
                        if other.any():
                            held.append((np.full(other.sum(), i), near[other] + shift, far[other]))
                            if sum(len(h[0]) for h in held) > HELD_PAIRS:
                                forest()
                    if held:
                        emit(forest())
            yield pa.RecordBatch.from_pydict({"source_id": pa.array(u, pa.string()), "target_id": pa.array(v, pa.string())})

    return run


def spanning_links(items: DataFrame, params: Params) -> DataFrame:
    """source_id, target_id (fingerprints): linked pairs whose components are those of all links.

    ``items``: distinct (fingerprint, shingles), written.
    """
    radius, tile = params.radius, params.tile
    pop = sum((F.bit_count(_word(k)) for k in range(params.words)), F.lit(0)).cast("int")
    base = items.select("fingerprint", "shingles", pop.alias("pop"))
    if params.ratio:
        # Class c holds counts in [ratio^-c, ratio^-(c+1)); each item stands in its own cell and, as a
        # guest, in the one below, where guests are compared with the cell's own items only.
        c = F.floor(F.log(F.greatest(F.col("shingles"), F.lit(1)).cast("double")) / F.lit(-np.log(params.ratio))).cast("long")
        cells = base.withColumn("cell", F.explode(F.array(
            F.struct(F.lit(0).alias("kind"), c.alias("value"), F.lit(0).alias("guest")), F.struct(F.lit(0).alias("kind"), (c - 1).alias("value"), F.lit(1).alias("guest")))))
    else:
        keyed = base.withColumn("cell", F.explode(block_keys(_word(0), radius)))
        cells = keyed.withColumn("cell", F.struct("cell.kind", "cell.value", F.lit(0).alias("guest")))
    cells = cells.select("fingerprint", "shingles", "pop", "cell.kind", "cell.value", "cell.guest")
    # Number the items of each cell along the population count: only counts are ordered, at most
    # one row for each population count of a cell.
    counts = cells.groupBy("kind", "value", "guest", "pop").agg(F.count("*").alias("n"))
    by_cell = Window.partitionBy("kind", "value")
    placed = counts.withColumn("start", F.sum("n").over(by_cell.orderBy("guest", "pop")) - F.col("n")).withColumn("total", F.sum("n").over(by_cell))
    placed = placed.withColumn("hosts", F.sum(F.when(F.col("guest") == 0, F.col("n")).otherwise(0)).over(by_cell))
    placed = placed.where("total > 1 AND hosts > 0").withColumn("first", F.when(F.col("guest") == 1, F.ceil(F.col("hosts") / tile)).otherwise(0) * tile - F.when(F.col("guest") == 1, F.col("hosts")).otherwise(0))
    placed = placed.select("kind", "value", "guest", "pop", "n", (F.col("start") + F.col("first")).alias("start"))
    placed = written(placed, "simhash-cells")
    key = ["kind", "value"]
    tiles = placed.withColumn("tile", F.explode(F.sequence(F.floor(F.col("start") / tile), F.floor((F.col("start") + F.col("n") - 1) / tile))))
    tiles = tiles.groupBy(*key, "guest", "tile").agg(F.min("pop").alias("low"), F.max("pop").alias("high"))
    a, b = tiles.select(*key, F.col("guest").alias("ga"), F.col("tile").alias("ta"), F.col("low").alias("la"), F.col("high").alias("ha")), tiles.select(
        *key, F.col("guest").alias("gb"), F.col("tile").alias("tb"), F.col("low").alias("lb"), F.col("high").alias("hb"))
    # Pairs of tiles within reach of each other; guests are not compared among themselves.
    pairs = a.join(b, key).where("ta <= tb AND ga = 0").where((F.col("lb") - F.col("ha") <= radius) & (F.col("la") - F.col("hb") <= radius)).select(*key, "ta", "tb")
    at = cells.join(placed, [*key, "guest", "pop"]).select(
        *key, F.floor((F.col("start") + F.pmod(F.xxhash64("fingerprint"), F.col("n"))) / tile).alias("tile"), F.struct("fingerprint", "shingles").alias("item"))
    grouped = [*key, "ta", "tb"]
    one = at.withColumnRenamed("tile", "ta").join(pairs, [*key, "ta"]).select(*grouped, "item", F.lit(0).alias("side"))
    two = at.withColumnRenamed("tile", "tb").join(pairs.where("ta <> tb"), [*key, "tb"]).select(*grouped, "item", F.lit(1).alias("side"))
    work = one.unionByName(two).groupBy(*grouped).agg(
        F.collect_list(F.when(F.col("side") == 0, F.col("item"))).alias("left"), F.collect_list(F.when(F.col("side") == 1, F.col("item"))).alias("right"))
    work = work.where((F.size("left") + F.size("right") > 1) & ((F.col("ta") == F.col("tb")) | (F.size("right") > 0)))
    work = work.select("left", "right", (F.col("ta") == F.col("tb")).alias("inner"))
    return work.mapInArrow(_compare(params.words, radius, params.ratio, params.near, _limits(params)), "source_id string, target_id string").distinct()


def _similar(params: Params):
    def run(batches):
        for batch in batches:
            u, v = [], []
            for source, target, texts in zip(batch.column("source_id").to_pylist(), batch.column("target_id").to_pylist(), batch.column("texts"), strict=True):
                a, b = (np.unique(shingle_hashes(t.as_py(), params.shingle)) for t in texts)
                both = len(np.intersect1d(a, b, assume_unique=True))
                if both >= params.similarity * (len(a) + len(b) - both):
                    u.append(source)
                    v.append(target)
            yield pa.RecordBatch.from_pydict({"source_id": pa.array(u, pa.string()), "target_id": pa.array(v, pa.string())})

    return run


def similar_links(links: DataFrame, items: DataFrame, docs: DataFrame, params: Params) -> tuple[DataFrame, DataFrame]:
    """Those links whose texts are as similar as asked; ``items`` names a document for each fingerprint.

    With them the rows of ``docs`` (doc_id, text) that hold the texts, and few others.
    """
    ends = links.select("source_id", "target_id", F.explode(F.array("source_id", "target_id")).alias("fingerprint"))
    asked = written(ends.join(items.select("fingerprint", F.col("lowest").alias("doc_id")).hint("merge"), "fingerprint"), "simhash-asked")
    # A bit table of fixed size keeps most other documents out of the shuffle; the join decides.
    bits = docs.sparkSession.sparkContext.broadcast(bit_table(asked.select(F.xxhash64("doc_id").alias("seed"))))

    @F.pandas_udf("boolean")
    def may_be_asked(seed: pd.Series) -> pd.Series:
        return pd.Series(in_table(bits.value, seed.to_numpy(np.int64).view(np.uint64)))

    near = docs.select("doc_id", text_of().alias("text")).where(may_be_asked(F.xxhash64("doc_id")))
    texts = near.join(asked.select("doc_id").distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    both = asked.join(texts, "doc_id").groupBy("source_id", "target_id").agg(F.collect_list("text").alias("texts")).where("size(texts) = 2")
    return both.mapInArrow(_similar(params), "source_id string, target_id string"), near


def _shingle_sets(n: int):
    def run(batches):
        for batch in small_slices(batches):
            sets = [np.unique(shingle_hashes(t, n)).view(np.int64) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "shingle_set": pa.array(sets, pa.list_(pa.int64()))})

    return run


def _compare_sets(params: Params):
    """Links as similar as asked inside a block or between two: each part is a star around its smallest name."""
    limits = _limits(params)

    def run(key: tuple[pa.Scalar, ...], block: pa.Table) -> pa.Table:
        _, a, b = (k.as_py() for k in key)
        block = block.sort_by("node_id")
        names, at = block.column("node_id").to_pylist(), block.column("at").to_numpy()
        sets = [np.asarray(x.values, np.int64) for x in block.column("shingle_set")]
        size = np.fromiter(map(len, sets), np.int64, len(sets))
        prints = np.frombuffer(bytes.fromhex("".join(names)), ">u8").astype(np.uint64).reshape(-1, params.words)
        part = np.arange(len(names))
        for i in np.flatnonzero(at == a).tolist():
            far = np.bitwise_count(prints ^ prints[i]).sum(1, dtype=np.int64)
            there = (at == b) & (np.arange(len(at)) > i) if a == b else at == b
            alike = np.minimum(size, size[i]) >= max(params.ratio, params.similarity) * np.maximum(size, size[i])
            for j in np.flatnonzero(there & alike & (far <= limits[np.minimum(np.minimum(size, size[i]), len(limits) - 1)])).tolist():
                if part[i] == part[j]:
                    continue
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if both >= params.similarity * (size[i] + size[j] - both):
                    low, high = sorted((part[i], part[j]))
                    part[part == high] = low
        linked = np.flatnonzero(part != np.arange(len(names))).tolist()
        return pa.table({"source_id": pa.array([names[i] for i in linked], pa.string()), "target_id": pa.array([names[part[i]] for i in linked], pa.string())})

    return run


def whole_groups(links: DataFrame, good: DataFrame, items: DataFrame, texts: DataFrame, params: Params) -> DataFrame:
    """Links with the components of all similar candidates, also those that the forest left out for one that was refuted.

    ``links``: the forest of the candidates, ``good``: those of them that hold; both
    written. A group of candidates without a refuted link is one component. In the
    others all items are compared whose fingerprints are candidates, with their
    shingle sets: in blocks of bounded size, a pair of blocks being one task's work.
    """
    refuted = links.join(good.hint("merge"), ["source_id", "target_id"], "left_anti").select(F.col("source_id").alias("node_id")).distinct()
    group = components(links).withColumnRenamed("component", "group")
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK_ITEMS), F.ceil(F.sum("shingles") / BLOCK_SHINGLES), F.lit(1)).cast("int")
    known = items.select(F.col("fingerprint").alias("node_id"), "shingles", F.col("lowest").alias("doc_id"))
    nodes = written(group.join(known.hint("merge"), "node_id").join(refuted.withColumn("refuted", F.lit(True)).hint("merge"), "node_id", "left"), "simhash-candidate-groups")
    sizes = nodes.groupBy("group").agg(blocks.alias("blocks"), F.count("refuted").alias("refuted"))
    placed = nodes.drop("refuted").join(sizes.hint("merge"), "group").withColumn("at", F.pmod(F.xxhash64("node_id"), "blocks").cast("int"))
    placed = written(placed, "simhash-blocks")
    settled = placed.where("refuted = 0").select(F.col("node_id").alias("source_id"), F.col("group").alias("target_id"))
    doubtful = placed.where("refuted > 0")
    sets = texts.join(doubtful.select("doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id"]).mapInArrow(_shingle_sets(params.shingle), "doc_id long, shingle_set array<long>")
    met = doubtful.join(sets, "doc_id").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("group", F.least("at", "other").alias("a"), F.greatest("at", "other").alias("b"), "node_id", "at", "shingle_set")
    return settled.unionByName(met.groupBy("group", "a", "b").applyInArrow(_compare_sets(params), "source_id string, target_id string"))


def near_groups(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """doc_id, fingerprint, component_id: the smallest doc_id that links reach, the row's own included.

    With ``similarity`` the ids must be known and different.
    """
    prints = written(fingerprints(docs, params), "simhash-prints")
    items = prints.groupBy("fingerprint").agg(F.max("shingles").alias("shingles"), F.min("doc_id").alias("lowest"))
    items = written(items, "simhash-items")
    links = spanning_links(items.select("fingerprint", "shingles"), params)
    if params.similarity:
        links = written(links, "simhash-candidates")
        good, texts = similar_links(links, items, docs, params)
        links = whole_groups(links, written(good, "simhash-similar"), items, texts, params)
    groups = components(links).withColumnRenamed("node_id", "fingerprint")
    named = items.join(groups.hint("merge"), "fingerprint", "left").withColumn("component", F.coalesce("component", "fingerprint"))
    ids = named.groupBy("component").agg(F.min("lowest").alias("component_id"))
    of_print = named.join(ids.hint("merge"), "component").select("fingerprint", "component_id")
    return prints.select("doc_id", "fingerprint").join(of_print, "fingerprint").select("doc_id", "fingerprint", "component_id")


def first_of_groups(docs: DataFrame, params: Params = SIMILAR) -> DataFrame:
    """``docs`` (a table read from files) with one document of each group of near-duplicates, all columns."""
    placed = docs.withColumn("_place", F.monotonically_increasing_id())
    groups = near_groups(placed.select(F.col("_place").alias("doc_id"), "text"), params)
    stay = written(groups.where("doc_id = component_id").select(F.col("doc_id").alias("_place")), "simhash-stay")
    return placed.join(stay, "_place", "left_semi").drop("_place")
