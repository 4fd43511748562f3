"""Cross-tokenizer alignment against plain Python over the tokenizers' own encoders."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from starloom.llm import alignment as al

PATHS = al.Tokenizers(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def characters():
    """Character of the byte-level vocabulary -> byte, by its definition."""
    own = set(range(ord("!"), ord("~") + 1)) | set(range(ord("¡"), ord("¬") + 1)) | set(range(ord("®"), ord("ÿ") + 1))
    out, n = {}, 0
    for b in range(256):
        if b in own:
            out[chr(b)] = b
        else:
            out[chr(256 + n)] = b
            n += 1
    return out


def plain(rows):
    """Rows of the query, sorted: ends compared as sets, counts by a dictionary."""
    a_coder, b_coder, byte = Tokenizer.from_file(PATHS.a), sentencepiece.SentencePieceProcessor(model_file=PATHS.b), characters()
    a_coder.encode_special_tokens = True
    found, counts = [], Counter()
    for i, text in rows:
        a, b = [], []
        if text:
            whole = b" " + text.encode()
            a = a_coder.encode(" " + text, add_special_tokens=False).ids
            b = b_coder.encode(text)
            a_bytes = [bytes(byte[c] for c in a_coder.id_to_token(t)) for t in a]
            b_bytes = [bytes([int(p[3:5], 16)]) if b_coder.is_byte(t) else p.replace("▁", " ").encode() for t in b for p in [b_coder.id_to_piece(t)]]
            if b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
                a, b = [], []
        groups, links = [], []
        if a:
            ends = lambda parts: np.cumsum([len(x) for x in parts]).tolist()
            at_a, at_b = {e: k for k, e in enumerate(ends(a_bytes))}, {e: k for k, e in enumerate(ends(b_bytes))}
            p = q = 0
            for e in sorted(set(at_a) & set(at_b)):
                groups.append((a[p:at_a[e] + 1], b[q:at_b[e] + 1]))
                links.append((a[at_a[e]], b[at_b[e]]))
                p, q = at_a[e] + 1, at_b[e] + 1
        counts.update(links)
        found.append((i, a, b, groups, links))
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    digest = lambda g: hashlib.sha256(";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g).encode()).hexdigest() if g else ""
    return sorted(((i, len(a), len(b), len(g), len(ln), sum(counts[p] == best[p[1]] for p in ln), sum(counts[p] for p in ln), digest(g)) for i, a, b, g, ln in found), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, [1], 0) for i, t in rows], "doc_id long, text string, a_ids array<int>, slice int")


def texts(n, seed):
    rng = random.Random(seed)
    words = ["the", "Straße", "naïve", "don't", "1234567", "zürich,", "misalignment", "token", "ﬁne", "…", "😀", "中文字", "x" * 30, "<|endoftext|>", "</s>", "\t", "  ", "\n", "Über", "ly"]
    return [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 60))) for _ in range(n)]


EDGES = [(1, None), (2, ""), (3, " "), (4, "a"), (5, " leading"), (6, "trailing "), (7, "two  spaces"), (8, "▁under"), (9, "\x00nul"), (10, "é combining"), (11, "<s> <unk> <|endoftext|>"),
         (None, "null id"), (4, "a"), (12, "word " * 30000), (13, "z" * 5000), (14, " nbsp　wide"), (15, "same text here"), (16, "same text here")]


def test_equals_plain_python(spark):
    rows = EDGES + [(100 + i, t) for i, t in enumerate(texts(150, 1))]
    got = sorted((tuple(r) for r in al.summaries(al.align(frame(spark, rows), PATHS)).collect()), key=str)
    assert got == plain(rows)
    assert any(r[3] for r in got) and any(r[1] != r[3] for r in got)


def test_counts_of_pairs_over_several_slices(spark):
    rows = [(i, t) for i, t in enumerate(texts(40, 2))]
    aligned = al.align(frame(spark, rows).repartition(5), PATHS)
    counts = {(r["a_id"], r["b_id"]): r["links"] for r in al.link_counts(aligned).collect()}
    assert sum(counts.values()) == sum(r[4] for r in plain(rows))
    assert sorted((tuple(r) for r in al.summaries(aligned).collect()), key=str) == plain(rows)


def test_groups_cover_the_texts(spark):
    rows = [(i, t) for i, t in enumerate(texts(30, 4))]
    coders = al.Coders.at(PATHS)
    held = {r["doc_id"]: r for r in al.align(frame(spark, rows), PATHS).groups.collect()}
    assert len(held) == len(rows)
    for i, text in rows:
        r, p, q = held[i], 0, 0
        for n, m in zip(r["a_sizes"], r["b_sizes"], strict=True):
            a, b = r["a_ids"][p:p + n], r["b_ids"][q:q + m]
            assert b"".join(coders.a_bytes[x] for x in a) == b"".join(coders.b_bytes[x] for x in b)
            p, q = p + n, q + m
        assert b"".join(coders.a_bytes[x] for x in r["a_ids"]) in (b"", b" " + text.encode())


def test_empty_table(spark):
    assert al.summaries(al.align(frame(spark, []), PATHS)).collect() == []


@pytest.mark.parametrize("lane", [1, 7, 64, 1 << 20])
def test_lockstep_finds_common_ends(lane):
    rng = np.random.default_rng(lane)
    a, b = (np.unique(np.append(rng.integers(1, 5000, 1500), 5000)) for _ in range(2))
    x, y = al.lockstep(a, b, lane)
    assert a[x].tolist() == b[y].tolist() == np.intersect1d(a, b).tolist()


def test_fast_encoder_gives_the_file_s_ids():
    coder, own = al.Coders(PATHS), Tokenizer.from_file(PATHS.a)
    own.encode_special_tokens = True
    for text in texts(200, 3) + [" " * 3000 + "x", "\n" * 50, "a" * 4000, "'S 'll ’s", " x\u0085y​"]:
        assert coder.encode_a(" " + text) == own.encode(" " + text, add_special_tokens=False).ids

