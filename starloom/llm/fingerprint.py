"""Quartile bucket digests of documents.

Every window of five bytes gives six triplets (those that hold its newest byte);
each is hashed into one of 128 buckets. A digest writes, per bucket, the quartile
of its count (two bits), after a head with the length class and the quartile
ratios. Two digests differ by the steps between their quartiles, their lengths
and ratios; ``likeness`` maps that difference, which is bounded, to 0..1.

Null texts count as empty. Texts too short for a triplet have the digest of an
empty text of their bytes' hash: equal texts have equal digests, and short texts
are alike only if equal. Very long texts are counted whole, in constant memory.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starloom.llm.common import mixed, small_slices, text_of, written

BUCKETS = 128
# Positions in a five-byte window, newest last: the triplets that hold the newest byte.
TRIPLETS = ((0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3))
# Odd multipliers of the triplet hash, three per kind, made by the 64-bit finaliser.
_FACTORS = (mixed(np.arange(3 * len(TRIPLETS), dtype=np.uint64)).reshape(-1, 3) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_TOP = np.uint32(32 - 7)  # the seven high bits: 128 buckets
SHORT = 12
CHUNK = 1 << 20
STEP_COST = np.array([0, 1, 4, 9])
WORST = BUCKETS * STEP_COST[-1]


def bucket_counts(data: bytes) -> np.ndarray:
    """Hashed triplets per bucket, over the whole text, a chunk at a time."""
    total = np.zeros(BUCKETS, np.int64)
    raw = np.frombuffer(data, np.uint8)
    for start in range(0, max(len(raw) - 4, 0), CHUNK):
        part = raw[start:start + CHUNK + 4].astype(np.uint32)
        last, n = part[4:], len(part) - 4
        for k, (i, j) in enumerate(TRIPLETS):
            h = part[i:n + i] * _FACTORS[k, 0] + part[j:n + j] * _FACTORS[k, 1] + last * _FACTORS[k, 2]
            total += np.bincount(h >> _TOP, minlength=BUCKETS)
    return total


def digest(text: str) -> str:
    """Head (kind, length class, two ratios) and body (two bits per bucket), in hex."""
    data = text.encode()
    if len(data) < SHORT:
        return f"s{len(data):02x}{xxhash.xxh3_128_hexdigest(data)}{xxhash.xxh3_128_hexdigest(data, 1)}"
    counts = bucket_counts(data)
    q1, q2, q3 = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    codes = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    size = min(255, int(np.log(len(data)) * 12))
    ratio = [int(round(15 * x / q3)) if q3 else 0 for x in (q1, q2)]
    body = codes.reshape(-1, 4) @ np.array([64, 16, 4, 1], np.uint8)
    return f"t{size:02x}{ratio[0]:x}{ratio[1]:x}{body.astype(np.uint8).tobytes().hex()}"


def difference(a: str, b: str) -> float:
    """0 (alike) to 1: squared quartile steps, plus small shares for lengths and ratios, bounded."""
    if a == b:
        return 0.0
    if a[0] == "s" or b[0] == "s":
        return 1.0
    x, y = (np.unpackbits(np.frombuffer(bytes.fromhex(d[5:]), np.uint8)).reshape(-1, 2) @ np.array([2, 1]) for d in (a, b))
    # Independent texts differ by about 0.28 of the worst case in their buckets; that counts as 1.
    body = STEP_COST[np.abs(x - y)].sum() / WORST / 0.28
    size = abs(int(a[1:3], 16) - int(b[1:3], 16)) / 255
    ratio = sum(abs(int(a[k], 16) - int(b[k], 16)) for k in (3, 4)) / 30
    return float(min(1.0, body + 0.25 * size + 0.1 * ratio))


def likeness(a: str, b: str) -> float:
    return 1.0 - difference(a, b)


EDITS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every row: one narrow pass."""

    def run(batches):
        for batch in small_slices(batches):
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "fingerprint": pa.array([digest(t) for t in batch.column("text").to_pylist()], pa.string())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


def edit(text: str, following: str) -> str:
    """The last half of the text replaced by as much of the beginning of the following one."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def _edit_row(doc_id, text: str, print_: str, following: str, next_print: str) -> tuple:
    new = edit(text, following)
    new_print = print_ if new == text else digest(new)
    return doc_id, len(text), hashlib.sha256(new.encode()).hexdigest(), print_, new_print, likeness(print_, new_print), likeness(print_, next_print)


def _pairs_in_order(batches):
    """Rows arrive by descending id. Every row but the last meets its follower here; the first row
    and the last one leave with their texts, to meet across partitions."""
    names = EDITS.replace(",", "").split()[::2]
    first = before = None

    def packed(rows, ends=()):
        columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
        n = len(rows)
        table = pa.Table.from_pydict({c: list(v) for c, v in zip(names, columns, strict=True)}, schema=_ARROW)
        table = table.append_column("end", pa.nulls(n, pa.string())).append_column("text", pa.nulls(n, pa.string()))
        if ends:
            extra = pa.table({"doc_id": pa.array([d for _, d, _ in ends], pa.int64()), "end": [e for e, _, _ in ends], "text": [t for _, _, t in ends]})
            table = pa.concat_tables([table, extra], promote_options="default").select(table.column_names)
        return table.combine_chunks().to_batches()

    for batch in small_slices(batches):
        rows = []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            print_ = digest(text)
            if before is None:
                first = (doc_id, text)
            else:
                rows.append(_edit_row(*before, text, print_))
            before = (doc_id, text, print_)
        yield from packed(rows)
    if before is not None:
        yield from packed([], [("first", *first), ("last", *before[:2])])


_ARROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
                    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited text (see ``edit``), the follower being the
    next document by descending id and, after the smallest id, the largest.

    The rows are dealt out by ranges of the id into spark.sql.shuffle.partitions
    partitions (one shuffle of the texts) and stream through each range in order.
    Only the two end rows of a range are paired in a second step, whose size is
    the number of ranges. Rows of one id are ordered by their text's hash, equal
    rows by their place in the input, so a hot id is dealt over ranges too; null
    ids come last; a single document follows itself.
    """
    order = [F.col("doc_id").desc_nulls_last(), F.col("h"), F.col("place")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), F.xxhash64(text_of()).alias("h"), F.monotonically_increasing_id().alias("place"))
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    made = dealt.mapInArrow(_pairs_in_order, EDITS + ", end string, text string").withColumn("part", F.spark_partition_id())
    made = written(made, "fingerprint-edits")
    ends = made.where("end IS NOT NULL").select("part", "end", "doc_id", "text")
    # The number of ranges bounds this window: two numbers for each.
    spec = Window.orderBy("part")
    following = ends.where("end = 'last'").select("part").withColumn("next", F.lead("part").over(spec))
    smallest = ends.agg(F.min("part").alias("lowest"))
    following = following.join(F.broadcast(smallest)).select("part", F.coalesce("next", "lowest").alias("next"))
    heads = ends.where("end = 'first'").select(F.col("part").alias("next"), F.col("text").alias("following"))
    met = ends.where("end = 'last'").join(following, "part").join(heads, "next").select("doc_id", "text", "following")

    def across(batches):
        for batch in batches:
            rows = [_edit_row(d, t, digest(t), f, digest(f)) for d, t, f in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "following")), strict=True)]
            yield from pa.Table.from_pylist([dict(zip(_ARROW.names, r, strict=True)) for r in rows], schema=_ARROW).combine_chunks().to_batches()

    inside = made.where("end IS NULL").select(*_ARROW.names)
    return inside.unionByName(met.mapInArrow(across, EDITS))
