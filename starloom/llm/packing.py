"""Best-fit packing of tokenised documents, repacked until bounds certify the bins.

A document is its token ids and an end id; only a longer one than a sequence is
cut, into full pieces and a shorter last one. Pieces are dealt at random into
cells of bounded size, with their ids, and packed by best-fit decreasing. Dual
feasible functions give each cell a lower bound of its bins. A cell that needs no
more bins than its bound is certified: its bins stand, but for the emptiest one
where a part of a bin is free, as such parts add up over cells. A cell with a gap
takes its emptiest bins apart too. The pieces given back meet in fewer cells and are
packed anew, until they fit one cell or ``rounds`` are over. Every cell's bins and
bound are kept as its certificate. So ids move once, and a small part of them again.

``standing`` and ``sequences`` give the packed sequences, ``certificates`` the bounds of all cells;
``read_pieces`` takes the pieces out again; ``pack`` places rows without ids.

Null and empty texts are the end id alone. Repeated rows are documents each. Ties
are packed in the order of row numbers given when the pieces are made, which
also deal them out, so a hot id is spread. Very long texts give many pieces. Other
columns of the documents are not read.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.llm.common import give_back, small_slices, sums_by, text_of, written

AT_ONCE = 16  # runs of 500 words given to the tokenizer in one call
AT_A_TIME = 250  # sequences put together or read at once
RUN = 1 << 17  # words whose ids are put in place at once
_TOKENIZERS: dict[str, "WordTokenizer"] = {}


@dataclass(frozen=True)
class Params:
    """A cell has some ``cell_bytes`` of text, later ``cell_rows`` pieces; ``opened`` bins are taken apart for each bin above a cell's bound.

    A task encodes slices of ``slice_bytes`` of text, whose repeated words are encoded once, and keeps
    two generations of ``cached_words`` words (some 60 MB each at 300,000): memory against time.
    """

    capacity: int = 4_096
    end_id: int = 1
    cell_bytes: int = 24 << 20
    cell_rows: int = 16_384
    opened: int = 32
    rounds: int = 8
    slice_bytes: int = 8 << 20
    cached_words: int = 300_000


class WordTokenizer:
    """Ids of texts, word by word, for lower-casing tokenizers whose pieces never span white space
    or lie on both sides of where a letter or digit meets a punctuation mark.

    Words used lately are taken from two dictionaries: a full young one becomes the
    old one, and words that are used again move back. That bounds memory and
    changes no result. Of a new word the marks at its end are looked up alone; the
    rest are encoded many at a time. Where ids tell the end of a piece, words of
    letters alone follow each other and are parted there; if a run has another count
    of ends than of words, and for all other words, a character stands between them
    whose id nothing else has. Words that hold it, and texts that may hold a special
    token, are encoded as they stand.
    """

    MARK = "\x01"
    ENDS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
    SPECIAL = b"|>"

    def __init__(self, path: str, cached_words: int = 300_000):
        self.cached_words = cached_words
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.inner, self.young, self.old = Tokenizer.from_file(path), {}, {}
        self.mark = self._ids([self.MARK])[0]
        self.ends = self._end_ids()

    @classmethod
    def at(cls, path: str, cached_words: int = 300_000) -> "WordTokenizer":
        if path not in _TOKENIZERS:
            _TOKENIZERS[path] = cls(path)
        _TOKENIZERS[path].cached_words = cached_words
        return _TOKENIZERS[path]

    def _end_ids(self) -> np.ndarray | None:
        """For each id if it ends a piece; None for a vocabulary that does not mark ends."""
        suffix = getattr(self.inner.model, "end_of_word_suffix", None)
        if not suffix:
            return None
        known = self.inner.get_vocab(with_added_tokens=True)
        out = np.zeros(max(known.values()) + 1, bool)
        out[[i for token, i in known.items() if token.endswith(suffix)]] = True
        return out

    def _each(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; few at a time, as what the tokenizer tells of a text is far larger than its ids."""
        parts = []
        for k in range(0, len(texts), AT_ONCE):
            parts += [np.array(e.ids, "<u4") for e in self.inner.encode_batch_fast(texts[k:k + AT_ONCE], add_special_tokens=False)]
        return parts

    def _ids(self, texts: list[str]) -> np.ndarray:
        """The ids of the texts one after another."""
        return np.concatenate([np.zeros(0, "<u4"), *self._each(texts)])

    def _encode_letters(self, words: list[bytes]) -> tuple[dict[bytes, bytes], list[bytes]]:
        """The ids of words of letters alone, and the words that are left: a word has a piece at least, so as many ends as words are one for each."""
        out, left, runs = {}, [], [words[k:k + 500] for k in range(0, len(words), 500)]
        for run, ids in zip(runs, self._each([b" ".join(run).decode() for run in runs]), strict=True):
            stop = np.flatnonzero(self.ends[ids]) * 4 + 4
            if len(stop) == len(run):
                raw, stop = ids.tobytes(), stop.tolist()
                out.update((w, raw[a:b]) for w, a, b in zip(run, [0, *stop[:-1]], stop, strict=True))
            else:
                left += run
        return out, left

    def _encode_new(self, words: list[bytes]) -> dict[bytes, bytes]:
        mark = self.MARK.encode()
        out = {w: self._ids([w.decode()]).tobytes() for w in words if mark in w or self.SPECIAL in w}
        words = [w for w in words if w not in out]
        if self.ends is not None:
            letters = [w.isalpha() or not w.isascii() and w.decode().isalpha() for w in words]
            found, left = self._encode_letters([w for w, one in zip(words, letters, strict=True) if one])
            out.update(found)
            words = [*left, *(w for w, one in zip(words, letters, strict=True) if not one)]
        parts = [b" \x01 ".join(words[k:k + 500]).decode() + " \x01" for k in range(0, len(words), 500)]
        ids = self._ids(parts)
        raw, stop = ids.tobytes(), (np.flatnonzero(ids == self.mark) * 4).tolist()
        start = [0, *(x + 4 for x in stop)][:len(stop)]
        out.update((w, raw[a:b]) for w, a, b in zip(words, start, stop, strict=True))
        return out

    def _cut(self, word: bytes) -> tuple[bytes, bytes] | None:
        """A word and the marks at its end, where a letter or digit stands before them."""
        body = word.rstrip(self.ENDS)
        if not body or len(body) == len(word) or self.SPECIAL in word:
            return None
        if body[-1] < 128:
            return (body, word[len(body):]) if body[-1:].isalnum() else None
        last = unicodedata.normalize("NFC", body.decode()[-1]).lower()[-1]  # what the tokenizer sees before the marks
        return (body, word[len(body):]) if last.isalpha() else None

    def _unknown(self, words: list[bytes]) -> list[bytes]:
        """Words that neither dictionary has; those of the old one become young again."""
        young, old = self.young, self.old
        out = [w for w in words if w not in young]
        again = {w: old[w] for w in out if w in old}
        young.update(again)
        return [w for w in out if w not in again] if again else out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and ids per text."""
        special = pc.match_substring(texts, self.SPECIAL.decode())
        split = pc.ascii_split_whitespace(pc.if_else(special, texts, pc.ascii_lower(texts)))
        coded = split.values.dictionary_encode()
        words = coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
        self.young[b""] = b""
        held = list(map(self.young.get, words))
        new = [i for i, ids in enumerate(held) if ids is None]
        missing = self._unknown([words[i] for i in new])
        cuts = {w: c for w in missing if w[-1] < 128 and not w[-1:].isalnum() and (c := self._cut(w))}
        wanted = {x for c in cuts.values() for x in c}.union(w for w in missing if w not in cuts)
        self.young.update(self._encode_new(self._unknown(list(wanted))))
        young = self.young
        for w, (body, end) in cuts.items():
            young[w] = young[body] + young[end]
        for i in new:
            held[i] = young[words[i]]
        if len(young) > self.cached_words:
            self.young, self.old = {}, young
        size = np.fromiter(map(len, held), np.int64, len(held)) // 4
        start, codes = np.cumsum(size) - size, coded.indices.to_numpy()
        n, known = size[codes], np.frombuffer(b"".join(held), "<u4")
        ids, done = np.empty(int(n.sum()), "<u4"), 0
        for k in range(0, len(codes), RUN):  # positions take several times the room of the ids
            m = n[k:k + RUN]
            stop = done + int(m.sum())
            ids[done:stop] = known[np.repeat(start[codes[k:k + RUN]] - (np.cumsum(m) - m), m) + np.arange(stop - done)]
            done = stop
        return ids, sums_by(n, np.diff(split.offsets.to_numpy()).astype(np.int64))


def pieces(docs: DataFrame, tokenizer: str, params: Params = Params(), with_ids: bool = False, narrow: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, row (unique) and, if asked for, ids; ``narrow``: as bytes, two of each id where that holds them, or else four."""

    def run(batches):
        from pyspark import TaskContext

        row, coder, cap = TaskContext.get().partitionId() << 40, WordTokenizer.at(tokenizer, params.cached_words), params.capacity
        for batch in small_slices(batches, limit=params.slice_bytes):
            every, counts = coder.encode(batch.column("text"))
            size = counts + 1
            ids, last = np.full(int(size.sum()), params.end_id, "<u4"), np.cumsum(size) - 1
            ids[np.delete(np.arange(len(ids)), last)] = every
            del every
            per = -(-size // cap)  # pieces of each document
            doc = np.repeat(np.arange(len(size)), per)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
            start = piece * cap
            length = np.minimum(size[doc] - start, cap)
            edges = np.concatenate([[0], np.cumsum(length)])  # pieces stand one after another
            raw = memoryview(ids).cast("B")
            crc = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
            arrays = [batch.column("doc_id").take(pa.array(doc)), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc, np.arange(row, row + len(doc))))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "row"]
            row += len(doc)
            if narrow:
                arrays, names = [*arrays, _narrowed(ids, edges)], [*names, "ids"]
            elif with_ids:
                arrays, names = [*arrays, pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(ids.view("<i4")))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, row long" + (", ids binary" if narrow else ", ids array<int>" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, schema)


def lower_bound(length: np.ndarray, count: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs: the best of two families of dual feasible functions, rounded up."""
    return -(-least_volume(length, count, capacity) // 1)


def least_volume(length: np.ndarray, count: np.ndarray, capacity: int) -> Fraction:
    """The best of the dual feasible functions as it is; no packing has fewer bins."""
    x, n = length.astype(np.int64), count.astype(np.int64)
    best = Fraction(int((x * n).sum()), capacity)
    for k in range(1, 21):  # u(k): x if (k + 1) x is whole, else floor((k + 1) x) / k
        whole = (k + 1) * x % capacity == 0
        best = max(best, Fraction(int((np.where(whole, k * x, (k + 1) * x // capacity * capacity) * n).sum()), k * capacity))
    for e in np.unique(np.concatenate([x[x <= capacity // 2], [0]])).tolist()[:: max(1, len(x) // 256)]:  # large ones fill a bin, small ones count nothing
        best = max(best, Fraction(int((np.where(x > capacity - e, capacity, np.where(x < e, 0, x)) * n).sum()), capacity))
    return best


def best_fit_decreasing(length: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each item, and the room left in each bin."""
    order = np.argsort(-length, kind="stable")
    bin_of, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
    levels: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms: list[int] = []
    open_levels = 0  # bit r: a bin with room r is open
    for i, n in zip(order.tolist(), length[order].tolist(), strict=True):
        fits = open_levels >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = levels[room].pop()
            if not levels[room]:
                open_levels ^= 1 << room
        else:
            room, b = capacity, len(rooms)
            rooms.append(capacity)
        bin_of[i], offset[i] = b, capacity - room
        left = room - n
        rooms[b] = left
        if left:
            if not levels[left]:
                open_levels |= 1 << left
            levels[left].append(b)
    return bin_of, offset, np.array(rooms, np.int64)


def _joined(ids: pa.Array, length: np.ndarray) -> tuple[np.ndarray, int]:
    """The ids of all pieces one after another as bytes, and bytes per id: two, or four if a piece needs them."""
    ends = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset:ids.offset + len(ids) + 1]
    if int(ends[-1] - ends[0]) == 2 * int(length.sum()):
        return np.frombuffer(ids.buffers()[2], np.uint8)[ends[0]:ends[-1]], 2
    wide = [np.frombuffer(x, "<u2" if len(x) == 2 * n else "<u4").astype("<u4") for x, n in zip(ids.to_pylist(), length.tolist(), strict=True)]
    return np.concatenate(wide).view(np.uint8), 4


def _bytes(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values between the ends of one buffer."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _narrowed(ids: np.ndarray, edges: np.ndarray) -> pa.Array:
    """The ids between the edges as bytes: two of each id where that holds them, or else four."""
    if not len(ids) or ids.max() < 1 << 16:
        return _bytes(ids.astype("<u2"), 2 * edges)
    parts = [ids[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
    return pa.array([(x.astype("<u2") if x.max() < 1 << 16 else x).tobytes() for x in parts], pa.binary())


def _forget() -> None:
    """A worker that tokenised before holds words that are no longer needed."""
    if _TOKENIZERS:
        _TOKENIZERS.clear()
        give_back()


def _pack_cell(params: Params, last: bool):
    """A cell's bins, a row each with its pieces in order and their ids; ``open``: the pieces are given back."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        _forget()
        table = table.drop_columns(["cell"]).combine_chunks()
        table = table.take(pa.array(np.argsort(table["row"].to_numpy(), kind="stable")))
        length = table["length"].to_numpy()
        bin_of, offset, room = best_fit_decreasing(length, params.capacity)
        least = least_volume(*np.unique(length, return_counts=True), params.capacity)
        bins, bound = len(room), -(-least // 1)
        opened = np.zeros(bins, bool)
        if not last and bins > least:
            emptiest = np.argsort(-room, kind="stable")[:max(1, params.opened * int(bins - bound))]
            opened[emptiest[room[emptiest] > 0]] = True
        order = np.lexsort((offset, bin_of))
        table, length = table.take(pa.array(order)), length[order]
        names = [c for c in table.column_names if c != "ids"]
        held = pa.StructArray.from_arrays([pa.array(offset[order]), *[table[c].combine_chunks() for c in names]], names=["offset", *names])
        edges = np.concatenate([[0], np.cumsum(np.bincount(bin_of, minlength=bins))])
        ends = lambda x: pa.array(x, pa.int32())
        one = lambda v: pa.array(np.full(bins, int(v)))
        ids, width = pa.nulls(bins, pa.binary()), 0
        if "ids" in table.column_names:
            raw, width = _joined(table["ids"].combine_chunks(), length)
            ids = _bytes(raw, np.concatenate([[0], np.cumsum(length)])[edges] * width)
        return pa.table({
            "cell": one(key[0].as_py()), "bin": pa.array(np.arange(bins)), "open": pa.array(opened), "bins": one(bins), "bound": one(bound),
            "ids": ids, "width": one(width), "pieces": pa.ListArray.from_arrays(ends(edges), held)})

    return run


def _pack(rows: DataFrame, cells: int, params: Params) -> DataFrame:
    """A written row per bin and round: round, cell, bin, open, bins, bound, ids (of ``width`` bytes each; null if ``rows`` has none), pieces (offset and the other columns)."""
    kind = ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in rows.schema if f.name != "ids")
    names = [c for c in rows.columns if c != "ids"]
    schema, out = f"cell long, bin long, open boolean, bins long, bound long, ids binary, width long, pieces array<struct<offset:long,{kind}>>", None
    for number in range(params.rounds):
        last = cells == 1 or number == params.rounds - 1
        dealt = rows.withColumn("cell", F.pmod(F.xxhash64(F.lit(number), "row"), F.lit(cells).cast("long")))
        made = dealt.groupBy("cell").applyInArrow(_pack_cell(params, last), schema)
        packed = written(made.withColumn("round", F.lit(number)), "packing-bins", "zstd")
        out = packed if out is None else out.unionByName(packed)
        if last:
            break
        given = packed.where("open").select("ids", "width", F.explode("pieces").alias("p"))
        ids = [F.expr("substring(ids, cast(p.offset * width + 1 AS int), cast(p.length * width AS int))").alias("ids")] if "ids" in rows.columns else []
        rows = given.select(*[F.col(f"p.{c}").alias(c) for c in names], *ids)
        cells = max(1, -(-rows.count() // params.cell_rows))
    return out


def _numbered(bins: DataFrame) -> DataFrame:
    """The bins that stand, with sequence_id."""
    return bins.where("NOT open").withColumn("sequence_id", F.shiftleft(F.col("round").cast("long"), 58) + F.shiftleft("cell", 24) + F.col("bin"))


def certificates(bins: DataFrame) -> DataFrame:
    """A row per cell of every round: its bins, the lower bound for them, and whether it is certified (they are equal)."""
    cells = bins.groupBy("round", "cell").agg(F.max("bins").alias("bins"), F.max("bound").alias("bound"), F.count_if("open").alias("opened"))
    return cells.withColumn("certified", F.col("bins") == F.col("bound"))


def pack(rows: DataFrame, params: Params = Params()) -> DataFrame:
    """``rows`` (as of ``pieces``, without ids) with sequence_id and offset."""
    rest = written(rows, "packing-pieces")
    bins = _pack(rest, max(1, -(-rest.count() // params.cell_rows)), params)
    return _numbered(bins).select("sequence_id", F.explode("pieces").alias("p")).select("p.*", "sequence_id")


def bins(docs: DataFrame, tokenizer: str, params: Params = Params()) -> DataFrame:
    """The bins of all rounds with ids, written; of these ``certificates`` and ``standing`` are made.

    Cells are sized by the bytes of the texts before they are tokenised, so the pieces
    go to their cells as they are made.
    """
    size = docs.agg(F.sum(F.octet_length(text_of()) + 1).alias("n")).first()["n"] or 0
    rows = pieces(docs, tokenizer, params, narrow=True).drop("start", "ids_crc32")
    return _pack(rows, max(1, -(-size // params.cell_bytes)), params)


def standing(bins: DataFrame) -> DataFrame:
    """The packed sequences as they are written: sequence_id, ids (bytes, ``width`` of each id), pieces (offset, doc_id, piece, in order)."""
    held = F.transform("pieces", lambda p: F.struct(p["offset"].alias("offset"), p["doc_id"].alias("doc_id"), p["piece"].alias("piece")))
    return _numbered(bins).select("sequence_id", "ids", "width", held.alias("pieces"))


def sequences(docs: DataFrame, tokenizer: str, params: Params = Params()) -> DataFrame:
    """The packed sequences: sequence_id, ids (at most ``capacity``), pieces."""

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, AT_A_TIME):
                part = batch.slice(k, AT_A_TIME)
                ids, size = _ids_of(part)
                yield pa.RecordBatch.from_pydict({
                    "sequence_id": part.column("sequence_id"), "ids": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(ids)), "pieces": part.column("pieces")})

    return standing(bins(docs, tokenizer, params)).mapInArrow(run, "sequence_id long, ids array<int>, pieces array<struct<offset:long,doc_id:long,piece:int>>")


def _ids_of(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all sequences one after another, and ids per sequence, from lists or from bytes."""
    held = part.column("ids")
    if pa.types.is_list(held.type):
        return held.flatten().to_numpy(), held.value_lengths().to_numpy().astype(np.int64)
    width = part.column("width").to_numpy()
    ids = [np.frombuffer(x, f"<u{w}").astype(np.int32) for x, w in zip(held.to_pylist(), width.tolist(), strict=True)]
    return np.concatenate([np.zeros(0, np.int32), *ids]), np.array([len(x) for x in ids], np.int64)


def read_pieces(made: DataFrame, params: Params = Params(), with_ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset and, if asked for, ids of all pieces, as they stand in the sequences (``standing`` or ``sequences``)."""

    def run(batches):
        _forget()
        for batch in batches:
            for k in range(0, batch.num_rows, AT_A_TIME):
                part = batch.slice(k, AT_A_TIME)
                (ids, size), counts = _ids_of(part), part.column("pieces").value_lengths().to_numpy().astype(np.int64)
                flat = part.column("pieces").flatten()
                offset, piece = flat.field("offset").to_numpy(), flat.field("piece").to_numpy().astype(np.int64)
                at = np.append(np.repeat(np.cumsum(size) - size, counts) + offset, len(ids))  # a sequence is its pieces without gaps
                crc = [zlib.crc32(ids[a:b].astype("<i4").tobytes()) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                out = {
                    "doc_id": flat.field("doc_id"), "piece": flat.field("piece"), "start": pa.array(piece * params.capacity), "length": pa.array(np.diff(at)), "ids_crc32": pa.array(crc, pa.int64()),
                    "sequence_id": pa.array(np.repeat(part.column("sequence_id").to_numpy(), counts)), "offset": flat.field("offset")}
                if with_ids:
                    out["ids"] = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_pydict(out)
            give_back()

    return made.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + ", ids array<int>" * with_ids)


def bounds(packed: DataFrame, params: Params = Params()) -> DataFrame:
    """One row: sequences made and the lower bound for all pieces together (the histogram has at most ``capacity`` rows)."""
    sizes = packed.groupBy("length").agg(F.count("*").alias("n")).toPandas()
    made = packed.select("sequence_id").distinct().count()
    bound = lower_bound(sizes["length"].to_numpy(np.int64), sizes["n"].to_numpy(np.int64), params.capacity) if len(sizes) else 0
    return packed.sparkSession.createDataFrame([(made, bound)], "sequences long, bound long")
