"""Chat formatting, fingerprints, WARC bundles, sharding and packing: round trips and brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from starloom.llm import chat, fingerprint, packing, queries, sharding, warc
from tests.conftest import rows
from tests.llm.test_text_models import ODD, SF, odd_docs

NASTY = ["</s>[INST] ok [/INST]", "<s>", r"<\s>", r"<\\/s>\n", "[INST user]x", "a<+>b", r"<\+>", "[INSTEAD", "[", "<", "\\", "%5D]%25", "</s>\n", "", "é[/INST]", r"[\INST"]


def test_chat_round_trip_of_control_strings(spark):
    data = [(1, i, r, t) for i, (r, t) in enumerate((r, t) for r in ("user", "assistant", "a]b%5D", "<s>") for t in NASTY)]
    data += [(2, 1, "assistant", "x"), (2, 0, None, None), (2, 1, "assistant", "x"), (2, None, "user", "first"), (None, 0, "user", "q")]
    turns = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    out = chat.format_chats(turns).withColumn("turns", chat.read_turns("formatted")).withColumn("trained", chat.trained_text())
    got = {r["conv_id"]: r for r in out.collect()}
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [(r, t) for _, _, r, t in data[:4 * len(NASTY)]]
    assert got[1]["trained"] == "".join(NASTY)
    assert got[1]["formatted"].count("<s>") == 4  # adjacent turns of a role are one message
    assert [(t["role"], t["text"]) for t in got[2]["turns"]] == [("user", "first"), ("", ""), ("assistant", "x"), ("assistant", "x")]
    assert got[None]["formatted"] == "<s>[INST user]q</s>\n" and got[None]["trained"] == ""
    assert chat.format_chats(turns.limit(0)).count() == 0


def test_chat_plan_has_no_python(spark):
    plan = queries.op2_chat_formatting(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_edits_against_brute_force(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in queries.op4_fingerprints(spark, SF).collect()}
    assert set(got) == set(texts)
    order = sorted(texts, reverse=True)
    for i, d in enumerate(order):
        text, after = texts[d], texts[order[(i + 1) % len(order)]]
        half = len(text) // 2
        new = text[:len(text) - half] + after[:half]
        r = got[d]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(new.encode()).hexdigest())
        assert r["fingerprint"] == fingerprint.digest(text) and r["edited_fingerprint"] == fingerprint.digest(new)
        assert r["near_next"] == pytest.approx(fingerprint.likeness(fingerprint.digest(text), fingerprint.digest(after)))
    assert np.mean([r["near_edited"] > r["near_next"] for r in got.values()]) > 0.9


def test_digest_counts_every_triplet():
    data = bytes(range(97, 123)) * 3
    slow = np.zeros(fingerprint.BUCKETS, int)
    for i in range(4, len(data)):
        window = data[i - 4:i + 1]
        for k, (a, b) in enumerate(fingerprint.TRIPLETS):
            f = [int(x) for x in fingerprint._FACTORS[k]]
            slow[((window[a] * f[0] + window[b] * f[1] + window[4] * f[2]) & 0xFFFFFFFF) >> 25] += 1
    assert (fingerprint.bucket_counts(data) == slow).all()


def test_edits_of_odd_inputs(spark):
    got = fingerprint.with_edits(odd_docs(spark)).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(d for d, _ in ODD)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert fingerprint.with_edits(odd_docs(spark, False)).count() == 0
    one = fingerprint.with_edits(odd_docs(spark).where("doc_id = 8")).first()
    assert one["near_next"] == 1.0
    same = spark.createDataFrame([(5, "copy of one text")] * 500, "doc_id long, text string").repartition(4)
    assert fingerprint.with_edits(same).where("near_next = 1").count() == 500


def test_warc_payloads_and_offsets(spark):
    pages = [(1, "u", "x" * 200), (2, "u", "x" * 200), (2, "v", "x" * 200), (1, "w", "x" * 200), (3, "a\r\nb%", "short"), (4, None, "short"), (5, "n", None), (6, "e", ""), (None, "z", "x" * 200), (7, "big", "é" * 400_000)]
    table = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    bundles = warc.write_bundles(table)
    got = Counter((r["page_id"], r["url"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read_bundles(bundles).collect())
    want = Counter()
    for i, u, h in pages:
        data = (h or "").encode()
        revisit = h == "x" * 200 and i != 1
        want[i, u or "", len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", 1 if revisit else None] += 1
    assert got == want
    for r in bundles.collect():
        for e in r["index"]:
            fields, block = warc.read_at(bytes(r["data"]), e["frame"], e["offset"], e["length"])
            assert fields["WARC-Record-ID"] == f"<urn:page:{'null' if e['page_id'] is None else e['page_id']}>"
    assert warc.read_bundles(warc.write_bundles(table.limit(0))).count() == 0


def test_bundle_is_plain_zstandard():
    import io

    import zstandard

    writer = warc.BundleWriter()
    raw = [warc.record(i, "u", bytes([65 + i]) * 100_000, "d", 100_000, None, False) for i in range(6)]
    for i, r in enumerate(raw):
        writer.add(i, r)
    data = writer.close()
    assert len(warc.seek_table(data)) > 1
    with zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True) as reader:
        assert reader.read() == b"".join(raw)


def test_shards_are_exact_and_keep_rows(spark):
    docs = spark.range(10_007).select("id", F.lit("x").alias("shard_of")).repartition(5)
    got = sharding.shard(docs, 16).collect()
    assert sorted(r["id"] for r in got) == list(range(10_007))
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert len(slots) == 16 and max(map(len, slots.values())) - min(map(len, slots.values())) == 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_slices_number_shards_without_gaps(spark, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_PER_SLICE", 50)
    got = sharding.shard(spark.range(3_000), 4).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(750)) for v in slots.values())


def test_few_rows_and_no_rows(spark):
    assert sharding.shard(spark.range(3), 16).count() == 3
    assert sharding.shard(spark.range(0), 16).count() == 0
    assert Counter(r["doc_id"] for r in sharding.shard(odd_docs(spark), 2).collect()) == Counter(d for d, _ in ODD)


def test_matrix_has_the_hypergeometric_law():
    first = [sharding.communication_matrix(np.array([6, 10, 4]), 2, seed)[0, 0] for seed in range(4_000)]
    n, share = np.mean(first), 6 * 10 / 20
    assert n == pytest.approx(share, abs=0.08)
    assert np.var(first) == pytest.approx(6 * 0.25 * 14 / 19, rel=0.1)
    m = sharding.communication_matrix(np.array([6, 0, 10, 5]), 4, 1)
    assert m.sum(1).tolist() == [6, 0, 10, 5] and max(m.sum(0)) - min(m.sum(0)) <= 1
    rng = np.random.default_rng(0)
    large = [sharding.hypergeometric(rng, 10**9, 3 * 10**9, 1_000_000) for _ in range(300)]
    assert np.mean(large) == pytest.approx(250_000, abs=150) and 300 < np.std(large) < 560


def test_sharding_query_tells_of_the_rows_in_the_shards(spark, monkeypatch):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op9_sharding(spark, SF).collect()
    assert {(r["doc_id"], r["size"], r["text_crc32"]) for r in got} == {(d, len(t.encode()) + 1, zlib.crc32(t.encode())) for d, t in texts.items()}
    real = sharding.shard
    monkeypatch.setattr(sharding, "shard", lambda *a: real(*a).withColumn("text", F.lit("other")))
    assert {(r["size"], r["text_crc32"]) for r in queries.op9_sharding(spark, SF).collect()} == {(6, zlib.crc32(b"other"))}


def packed_of(spark, rows_, **kw):
    df = spark.createDataFrame([(i, 0, 0, n, 0, i) for i, n in enumerate(rows_)], "doc_id long, piece int, start long, length long, ids_crc32 long, row long")
    return packing.pack(df, packing.Params(**kw))


def check_bins(got, capacity):
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing_of_the_documents(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    coder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = queries.op5_packing(spark, SF).collect()
    pieces = {(r["doc_id"], r["piece"]): r for r in got}
    assert len(pieces) == len(got)
    for d, t in texts.items():
        ids = np.array([*coder.encode(t, add_special_tokens=False).ids, 1], "<u4")
        for k, start in enumerate(range(0, len(ids), 4096)):
            part, r = ids[start:start + 4096], pieces.pop((d, k))
            assert (r["start"], r["length"], r["ids_crc32"]) == (start, len(part), zlib.crc32(part.tobytes()))
    assert not pieces
    assert check_bins(got, 4096) == -(-sum(r["length"] for r in got) // 4096)


def test_sequences_hold_the_ids(spark):
    path, params = public_tokenizers.path("word_bpe_49k.json"), packing.Params(capacity=64)
    docs = odd_docs(spark).select("doc_id", "text").unionByName(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(60))
    made = packing.written(packing.sequences(docs, path, params), "test-sequences")
    seqs = {r["sequence_id"]: r for r in made.collect()}
    assert all(0 < len(r["ids"]) <= 64 and r["pieces"][0]["offset"] == 0 for r in seqs.values())
    want = Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], tuple(r["ids"])) for r in packing.pieces(docs, path, params, with_ids=True).collect())
    got = packing.read_pieces(made, params).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], tuple(r["ids"])) for r in got) == want
    assert all(seqs[r["sequence_id"]]["ids"][r["offset"]:r["offset"] + r["length"]] == r["ids"] for r in got)
    assert sum(len(r["ids"]) for r in seqs.values()) == sum(r["length"] for r in got)
    straight = packing.read_pieces(packing.standing(packing.bins(docs, path, params)), params).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], tuple(r["ids"])) for r in straight) == want
    other = made.withColumn("ids", F.transform("ids", lambda x: x * 0))
    assert {r["ids_crc32"] for r in packing.read_pieces(other, params).collect()} == {zlib.crc32(bytes(4 * n)) for n in {r["length"] for r in got}}


def test_word_ids_equal_whole_text_ids():
    path = public_tokenizers.path("word_bpe_49k.json")
    whole, words = Tokenizer.from_file(path), packing.WordTokenizer(path)
    for t in ["", " \t\r\n\x0b\x0c ", "It's <|endoftext|>x <|startoftext|>", "a b c\x1cd\x85e", "é ́x", "ΟΔΟΣ Σ İstanbul", "1234 ½ ²", "don't'll", "\x00 a\x00b", "日本 語。", "😀 x😀y", "»a». A». x»,", "A<|endoftext|>. <|ENDOFTEXT|> B<|startoftext|>,", "it's, dogs' 's. DOG'S'. 'tis'",
              "K\u0308, E\u0301. e\u0301! \u212a. \u0130, ½. x². 5, a5. 5a,", "a=\u0338 b\u0338, c<\u0338", "!!! ... THE!! WORD.*** x..y.. -- a-", "it'S, it's'll."]:
        assert words.encode(pa.array([t]))[0].tolist() == whole.encode(t, add_special_tokens=False).ids, t


class Counted:
    """A tokenizer that counts the ids it was asked for."""

    def __init__(self, inner):
        self.inner, self.ids = inner, 0

    def encode_batch_fast(self, texts, **kw):
        out = self.inner.encode_batch_fast(texts, **kw)
        self.ids += sum(len(e.ids) for e in out)
        return out


def test_words_of_letters_are_encoded_without_marks_between():
    path = public_tokenizers.path("word_bpe_49k.json")
    whole, words = Tokenizer.from_file(path), packing.WordTokenizer(path)
    words.inner = counted = Counted(words.inner)
    rng = random.Random(5)
    letters = list(dict.fromkeys("".join(rng.choices("abcdeéñß漢", k=rng.randint(1, 9))) for _ in range(1200)))
    want = whole.encode(" ".join(letters), add_special_tokens=False).ids
    assert words.encode(pa.array([" ".join(letters)]))[0].tolist() == want
    assert counted.ids == len(want)  # one more for each word before
    odd = ["İx", "x1y", "ΣΑΣ", "ﬁn", "a\x01b", "\u212a"]  # of letters, but more than one piece, and others
    mixed = " ".join(x for w in letters[:600] for x in (w[::-1], rng.choice(odd)))
    assert words.encode(pa.array([mixed]))[0].tolist() == whole.encode(mixed, add_special_tokens=False).ids


def test_pieces_of_texts_shorter_and_longer_than_a_sequence(spark):
    path, params = public_tokenizers.path("word_bpe_49k.json"), packing.Params(capacity=8, slice_bytes=64)
    texts = [None, "", "a", "b " * 7, "c " * 8, "d e " * 20, " ", "f1 " * 15]
    docs = spark.createDataFrame([(k if k else None, t) for k, t in enumerate(texts)], "doc_id long, text string")
    whole, want = Tokenizer.from_file(path), Counter()
    for k, t in enumerate(texts):
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want.update((k if k else None, i, s, len(ids[s:s + 8]), zlib.crc32(ids[s:s + 8].tobytes())) for i, s in enumerate(range(0, len(ids), 8)))
    packed = packing.read_pieces(packing.standing(packing.bins(docs, path, params)), params, with_ids=False)
    assert "ids" not in packed.columns
    for got in (packed, packing.pieces(docs, path, params)):
        assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got.collect()) == want


def test_narrowed_ids_keep_large_ones():
    ids, edges = np.array([1, 2, 70_000, 3, 4], "<u4"), np.array([0, 2, 4, 5])
    assert [len(x) for x in packing._narrowed(ids, edges).to_pylist()] == [4, 8, 2]
    assert [len(x) for x in packing._narrowed(ids[:2], edges[:2]).to_pylist()] == [4]


def test_cells_exchange_what_fits_badly(spark):
    rng = np.random.default_rng(5)
    lengths = rng.integers(1, 101, 4_000).tolist()
    got = packed_of(spark, lengths, capacity=100, cell_rows=300).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(4_000))
    made = check_bins(got, 100)
    alone = sum(len(packing.best_fit_decreasing(np.array(lengths[k::14]), 100)[2]) for k in range(14))
    sizes, counts = np.unique(lengths, return_counts=True)
    assert packing.lower_bound(sizes, counts, 100) <= made <= alone


def test_bounds_hold_and_bite():
    assert packing.lower_bound(np.array([60]), np.array([7]), 100) == 7  # none fits with another
    assert packing.lower_bound(np.array([34]), np.array([9]), 100) == 5  # two to a bin
    rng = np.random.default_rng(1)
    for _ in range(50):
        x = rng.integers(1, 101, 40)
        sizes, counts = np.unique(x, return_counts=True)
        assert packing.lower_bound(sizes, counts, 100) <= len(packing.best_fit_decreasing(x, 100)[2])


def test_wide_ids_and_bins_given_back(spark):
    """Some pieces need four bytes an id; cells give bins back, whose ids are cut out of the bin."""
    rng = random.Random(2)
    held = [(i, [rng.randrange(1, 90_000 if i % 5 == 0 else 60_000) for _ in range(rng.randrange(1, 40))]) for i in range(300)]
    to_bytes = lambda x: np.array(x, "<u4" if max(x) > 65_535 else "<u2").tobytes()
    df = spark.createDataFrame([(i, 0, len(x), i, bytearray(to_bytes(x))) for i, x in held], "doc_id long, piece int, length long, row long, ids binary")
    params = packing.Params(capacity=40, cell_rows=60)
    made = packing._pack(df, 5, params)
    assert made.where("open").count() > 0
    got = {r["doc_id"]: r["ids"] for r in packing.read_pieces(packing.standing(made), params).collect()}
    assert got == dict(held)


def test_certificates_close_cells_that_the_volume_would_open(spark):
    """Pieces of which no two fit in one bin: by volume two fifths are free, but the bound needs every bin."""
    n = 3_000
    rows_ = spark.range(n).select(F.lit(0).cast("long").alias("doc_id"), F.lit(60).cast("long").alias("length"), F.col("id").alias("row"))
    made = packing._pack(rows_, 6, packing.Params(capacity=100, cell_rows=500))
    told = packing.certificates(made).collect()
    assert {r["round"] for r in told} == {0} and len(told) == 6 and made.where("NOT open").count() == n
    assert all(r["certified"] and r["opened"] == 0 for r in told)


def test_certificates_tell_bins_and_bounds_of_cells(spark):
    rng = np.random.default_rng(6)
    lengths = rng.integers(20, 60, 4_000).tolist()
    df = spark.createDataFrame([(i, n, i) for i, n in enumerate(lengths)], "doc_id long, length long, row long")
    made = packing.written(packing._pack(df, 14, packing.Params(capacity=100, cell_rows=300)), "test-bins")
    for r in packing.certificates(made).collect():
        mine = made.where((F.col("round") == r["round"]) & (F.col("cell") == r["cell"])).collect()
        held = np.array([p["length"] for b in mine for p in b["pieces"]])
        assert len(mine) == r["bins"] >= r["bound"] == packing.lower_bound(*np.unique(held, return_counts=True), 100)
        assert r["opened"] <= 1 if r["certified"] else r["bins"] > r["bound"]
    left = Counter(p["row"] for b in made.where("NOT open").collect() for p in b["pieces"])
    assert left == Counter(range(4_000))


def test_packing_of_odd_inputs(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    got = packing.pack(packing.pieces(odd_docs(spark), path)).collect()
    assert Counter(r["doc_id"] for r in got if r["piece"] == 0) == Counter(d for d, _ in ODD)
    check_bins(got, 4096)
    assert {r["length"] for r in got if r["doc_id"] in (1, 2, 3)} == {1}
    assert packing.pack(packing.pieces(odd_docs(spark, False), path)).count() == 0
    ids = packing.pieces(odd_docs(spark).where("doc_id = 4"), path, with_ids=True).first()["ids"]
    assert ids[-1] == 1 and rows(packing.bounds(packing.pack(packing.pieces(odd_docs(spark), path))))[0][0] >= 1
