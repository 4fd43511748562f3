"""Alignment of two tokenizers' ids by the bytes they cover, merged in lockstep.

A text with a space before it is encoded by a byte-level BPE (A) and the text by a
piece BPE (B). A token's end is the byte at which it ends; where an A and a B token
end together is a cut, and the two are linked. Texts of a slice are merged at once:
one NumPy state vector holds an A and a B pointer per lane; in each step every lane
compares the two ends, the lower one moves on, both move where they are equal, which
emits a cut, and lanes that are done are compacted away. A lane is a stretch of
``LANE`` bytes of one text, as cuts don't depend on what is before them; so a very
long text is many lanes and takes no more steps than others.

``align`` writes a row per document (ids of both sides and the number of tokens of each
side per group) and a row per slice (its distinct linked pairs, and which document
links which how often). ``link_counts`` adds the pairs up over all slices. ``summaries``
brings the counts back to the documents: a slice asks once for each of its distinct
pairs, so a pair that is in every text is a row per slice; a count is found by a join,
no table of pairs is held whole anywhere.

Null and empty texts, and those whose joined token bytes differ from space and text,
have no tokens: zeros, an empty digest. Null ids and repeated rows are documents like
others. Ties: all links of the highest count are best. An empty table gives no rows.
Other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.llm.common import give_back, small_slices, sums_by, text_of, written

SLICE = 2 << 20
LANE = 512
GROUPS = "doc_id long, a_ids array<int>, b_ids array<int>, a_sizes array<int>, b_sizes array<int>"
_SLICE = "docs:array<struct<doc_id:long,n_a:long,n_b:long,n_groups:long,digest:string>>,pairs:array<long>,times:array<long>,held:binary,often:binary"
_CODERS: dict[tuple, "Coders"] = {}
_DIGITS: dict[int, pa.Array] = {}


@dataclass(frozen=True)
class Tokenizers:
    """Paths of the byte-level BPE (A, a JSON file) and of the piece BPE (B, a model file)."""

    a: str
    b: str


@dataclass(frozen=True)
class Alignment:
    """``groups``: ids of both sides and the tokens of each side per group, a row per document. ``slices``: links, a row per slice."""

    groups: DataFrame
    slices: DataFrame


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the rest from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {**{chr(b): b for b in own}, **{chr(256 + k): b for k, b in enumerate(rest)}}


class Coders:
    """Both tokenizers with the bytes of every id.

    A's vocabulary is read from its file; ranks are its ids, as each merge made the next
    id, so the fast encoder gives the same ids as the file's own one, which takes over
    for texts that the fast one cannot split.
    """

    def __init__(self, paths: Tokenizers):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        self.path = paths.a
        with open(paths.a, encoding="utf-8") as f:
            told = json.load(f)
        special = {t["id"] for t in told["added_tokens"]}
        byte_of = _byte_of()
        ranks = {bytes(byte_of[c] for c in token): i for token, i in told["model"]["vocab"].items() if i not in special}
        self.fast = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.a_bytes[i] = token
        self.b = sentencepiece.SentencePieceProcessor(model_file=paths.b)
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        lengths = lambda table: np.array([len(x) for x in table], np.int64)
        self.a_length, self.b_length = lengths(self.a_bytes), lengths(self.b_bytes)

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    @classmethod
    def at(cls, paths: Tokenizers) -> "Coders":
        key = (paths.a, paths.b)
        if key not in _CODERS:
            _CODERS[key] = cls(paths)
        return _CODERS[key]

    def encode_a(self, text: str) -> list[int]:
        try:
            return self.fast.encode_ordinary(text)
        except BaseException as error:  # the pattern engine gives up on very long runs of white space by a panic
            if isinstance(error, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            from tokenizers import Tokenizer

            own = Tokenizer.from_file(self.path)
            own.encode_special_tokens = True
            return own.encode(text, add_special_tokens=False).ids

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """A and B ids of each text; none where a side's bytes differ from space and text."""
        none = np.zeros(0, np.int32)
        a_out, b_out = [none] * len(texts), [none] * len(texts)
        some = [i for i, t in enumerate(texts) if t]
        for i, b in zip(some, self.b.encode([texts[i] for i in some], num_threads=1) if some else [], strict=True):
            whole = (" " + texts[i]).encode()
            if b"".join(map(self.b_bytes.__getitem__, b)) != whole:
                continue
            a = self.encode_a(" " + texts[i])
            if b"".join(map(self.a_bytes.__getitem__, a)) == whole:
                a_out[i], b_out[i] = np.array(a, np.int32), np.array(b, np.int32)
        return a_out, b_out


def lockstep(a_ends: np.ndarray, b_ends: np.ndarray, lane: int = LANE) -> tuple[np.ndarray, np.ndarray]:
    """Positions of A and B tokens that end together, in order.

    Ends rise over all texts of a slice (a text's bytes follow those of the one before).
    """
    if not len(a_ends):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edges = np.append(np.arange(0, int(a_ends[-1]), lane), int(a_ends[-1]))
    # A lane starts at the first tokens that end behind its edge and stops at those of the next lane.
    a, b = np.searchsorted(a_ends, edges, side="right"), np.searchsorted(b_ends, edges, side="right")
    i, j, a_stop, b_stop = a[:-1].copy(), b[:-1].copy(), a[1:], b[1:]
    a_met, b_met = [], []
    while True:
        open_ = (i < a_stop) & (j < b_stop)
        if not open_.all():  # lanes that are done leave the state
            i, j, a_stop, b_stop = i[open_], j[open_], a_stop[open_], b_stop[open_]
        if not len(i):
            break
        x, y = a_ends[i], b_ends[j]
        met = x == y
        a_met.append(i[met])
        b_met.append(j[met])
        i, j = i + (x <= y), j + (y <= x)
    a_cut, b_cut = np.concatenate(a_met), np.concatenate(b_met)
    order = np.argsort(a_cut)
    return a_cut[order], b_cut[order]


def _ends(ids: list[np.ndarray], length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All ids one after another, ids per text, and where each token ends."""
    flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
    return flat, np.array([len(x) for x in ids], np.int64), np.cumsum(length[flat])


def _list(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values.astype(np.int32)))


def _per_text(cuts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens in each group, and groups in each text, from the positions of the tokens that close a group."""
    ends = np.cumsum(counts)
    return np.diff(np.concatenate([[-1], cuts])), np.diff(np.concatenate([[0], np.searchsorted(cuts, ends, side="left")]))


def _told(ids: np.ndarray, sizes: np.ndarray, other: np.ndarray, offset: np.ndarray, last: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each token stands among those of both sides, group by group, and the text it is written as: id and mark."""
    group = np.repeat(np.arange(len(sizes)), sizes)
    mark = np.zeros(len(ids), np.int64)
    mark[np.cumsum(sizes) - 1] = last
    return np.arange(len(ids)) + offset[group], ids.astype(np.int64) * 3 + mark


def group_digests(a_ids: np.ndarray, b_ids: np.ndarray, a_sizes: np.ndarray, b_sizes: np.ndarray, groups: np.ndarray, written_as: pa.Array) -> list[str]:
    """sha256 of ``a1,a2|b1;a3|b2`` of each text, '' where there are no groups.

    ``written_as``: for each id and mark (comma, bar, semicolon) the characters; tokens
    are put in order and looked up at once, so the characters stand in one buffer.
    """
    b_before, a_upto = np.cumsum(b_sizes) - b_sizes, np.cumsum(a_sizes)
    a_at, a_codes = _told(a_ids, a_sizes, b_sizes, b_before, 1)
    b_at, b_codes = _told(b_ids, b_sizes, a_sizes, a_upto, 2)
    codes = np.empty(len(a_ids) + len(b_ids), np.int64)
    codes[a_at], codes[b_at] = a_codes, b_codes
    out = written_as.take(pa.array(codes))
    tokens = np.concatenate([[0], sums_by(a_sizes + b_sizes, groups).cumsum()]).astype(np.int64)
    ends = np.frombuffer(out.buffers()[1], np.int32)[:len(codes) + 1] if len(codes) else np.zeros(1, np.int32)
    raw = memoryview(out.buffers()[2]) if len(codes) else memoryview(b"")
    return [hashlib.sha256(raw[ends[a]:ends[b] - 1]).hexdigest() if b > a else "" for a, b in zip(tokens[:-1].tolist(), tokens[1:].tolist())]


def _digits(most: int) -> pa.Array:
    """For each id below a power of two above ``most``, and each mark, its characters; kept for the next slices."""
    n = 1 << max(16, most.bit_length())
    if n not in _DIGITS:
        _DIGITS[n] = pa.array([f"{i}{mark}" for i in range(n) for mark in ",|;"])
    return _DIGITS[n]


def _packed(values: np.ndarray) -> bytes:
    """Small whole numbers, byte plane by byte plane, compressed."""
    return zstandard.compress(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _unpacked(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def _slice_row(doc_ids: pa.Array, flat: dict[str, np.ndarray], counts: dict[str, np.ndarray]) -> pa.Array:
    """The documents' digests, the distinct linked pairs with their number, and which of them each document links how often."""
    groups = counts["a_sizes"]
    digests = group_digests(*flat.values(), groups, _digits(max(int(flat[c].max(initial=0)) for c in ("a_ids", "b_ids"))))
    linked = flat["a_ids"][np.cumsum(flat["a_sizes"]) - 1].astype(np.int64) << 32 | flat["b_ids"][np.cumsum(flat["b_sizes"]) - 1]
    pairs, place = np.unique(linked, return_inverse=True)
    # Sorted by document, then pair: steps between neighbours are small.
    held, often = np.unique(np.repeat(np.arange(len(groups)), groups) * len(pairs) + place, return_counts=True)
    docs = pa.StructArray.from_arrays([doc_ids, *map(pa.array, (counts["a_ids"], counts["b_ids"], groups, digests))], names=["doc_id", "n_a", "n_b", "n_groups", "digest"])
    one = lambda values: pa.array([values], pa.list_(pa.int64()))
    return pa.StructArray.from_arrays(
        [pa.ListArray.from_arrays(pa.array([0, len(groups)], pa.int32()), docs), one(pairs), one(np.bincount(place, minlength=len(pairs))),
         pa.array([_packed(np.diff(held, prepend=0))]), pa.array([_packed(often)])], names=["docs", "pairs", "times", "held", "often"])


def align(docs: DataFrame, tokenizers: Tokenizers) -> Alignment:
    """The groups of A and B tokens that cover the same bytes, per document, and the links of each slice; written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = Coders.at(tokenizers)
        for batch in small_slices(batches, limit=SLICE):
            a, b = coders.encode(batch.column("text").to_pylist())
            a_ids, a_counts, a_ends = _ends(a, coders.a_length)
            b_ids, b_counts, b_ends = _ends(b, coders.b_length)
            a_cut, b_cut = lockstep(a_ends, b_ends)
            (a_sizes, groups), (b_sizes, _) = _per_text(a_cut, a_counts), _per_text(b_cut, b_counts)
            flat = {"a_ids": a_ids, "b_ids": b_ids, "a_sizes": a_sizes, "b_sizes": b_sizes}
            counts = {"a_ids": a_counts, "b_ids": b_counts, "a_sizes": groups, "b_sizes": groups}
            told, ids = _slice_row(batch.column("doc_id"), flat, counts), batch.column("doc_id")
            lists = {c: _list(flat[c], counts[c]) for c in flat}
            yield pa.RecordBatch.from_pydict({"doc_id": ids, **lists, "slice": pa.nulls(len(ids), told.type)})
            yield pa.RecordBatch.from_pydict({"doc_id": pa.nulls(1, ids.type), **{c: pa.nulls(1, x.type) for c, x in lists.items()}, "slice": told})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    made = written(rows.mapInArrow(run, f"{GROUPS}, slice struct<{_SLICE}>"), "alignment", "zstd")
    return Alignment(made.where("slice IS NULL").drop("slice"), made.where("slice IS NOT NULL").select(F.monotonically_increasing_id().alias("slice"), "slice.*"))


def _asked(slices: DataFrame) -> DataFrame:
    return slices.select("slice", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("slice", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))


def _counted(asked: DataFrame) -> DataFrame:
    """pair (A id in the upper half), links, and whether no other A id is linked more often to its B id."""
    counts = asked.groupBy("pair").agg(F.sum("times").alias("links")).withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)))
    most = counts.groupBy("b").agg(F.max("links").alias("most"))  # a B id has at most A's vocabulary beside it
    return counts.join(most, "b").select("pair", "links", (F.col("links") == F.col("most")).alias("best"))


def link_counts(aligned: Alignment) -> DataFrame:
    """a_id, b_id, links, best: how often two ids are linked in all documents."""
    counted = _counted(_asked(aligned.slices))
    return counted.select(F.shiftright("pair", 32).cast("int").alias("a_id"), F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("b_id"), "links", "best")


_SUMMARY = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _brought_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            docs, answers = batch.column("docs").slice(k, 1).flatten(), batch.column("answers").slice(k, 1).flatten()
            links, best = answers.field("links").to_numpy(), answers.field("best").to_numpy(zero_copy_only=False).astype(np.int64)
            held, often = (_unpacked(batch.column(c)[k].as_py()) for c in ("held", "often"))
            doc, place = np.divmod(np.cumsum(held), max(1, len(links)))
            mine = np.bincount(doc, minlength=len(docs))
            yield pa.RecordBatch.from_pydict({
                **{c: docs.field(c) for c in ("doc_id", "n_a", "n_b", "n_groups")}, "n_links": sums_by(often, mine), "n_best": sums_by(often * best[place], mine),
                "count_sum": sums_by(often * links[place], mine), "groups_sha256": docs.field("digest")})
        give_back()


def summaries(aligned: Alignment) -> DataFrame:
    """Per document: tokens, groups, links, links of the highest count of their B id, sum of counts, digest of the groups."""
    slices, asked = aligned.slices, _asked(aligned.slices)
    answers = asked.select("slice", "pair").join(_counted(asked), "pair").groupBy(F.col("slice").alias("_slice")).agg(F.array_sort(F.collect_list(F.struct("pair", "links", "best"))).alias("answers"))
    return slices.select("slice", "docs", "held", "often").join(answers, F.col("slice") == F.col("_slice"), "left").select("docs", "held", "often", F.coalesce("answers", F.array().cast(answers.schema["answers"].dataType)).alias("answers")).mapInArrow(_brought_back, _SUMMARY)
