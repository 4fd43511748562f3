"""Line deduplication against plain Python: one build, and inserts and deletions in any order."""

import random

import numpy as np
import pytest

from starloom.llm import line_dedup as ld

SPACE = " \t\n\x0b\x0c\r"
UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def key(line):
    return line.strip(SPACE).translate(UPPER)


def plain(rows, least=10):
    """(doc_id, text, n_lines, n_dropped) as sorted rows; a null id is after all others."""
    order = lambda i: ld.LAST_ID if i is None else i
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least:
                holders.setdefault(key(line), set()).add(order(i))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < least or min(holders[key(x)]) == order(i)]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 5, "x") for i, t in rows], "doc_id long, text string, n_lines long, dropped string")


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def texts(n, seed, words=40):
    rng = random.Random(seed)
    line = lambda: f"{'  ' * rng.randrange(2)}Line {rng.randrange(words)} {'É' * rng.randrange(4)}{' ' * rng.randrange(3)}"
    return ["\n".join(line() for _ in range(rng.randrange(1, 9))) for _ in range(n)]


EDGES = [
    (1, None), (2, ""), (3, "\n"), (4, "a shared line\nA Shared Line \nshort"), (5, "\ta shared line\x0b\nshort\n"), (6, "\x85a shared line"), (7, "ÉÉÉÉÉÉÉÉÉ"), (8, "ÉÉÉÉÉÉÉÉÉ"),
    (9, "ÉÉÉÉÉÉÉÉÉÉ"), (10, "ÉÉÉÉÉÉÉÉÉÉ"), (11, "éééééééééé"), (None, "a shared line\nown line of nobody"), (None, "own line of nobody"), (12, "twice the same\ntwice the same"),
    (12, "twice the same\nrow of equal id"), (13, "twice the same"), (14, "a shared line\n" * 3000 + "tail of it"), (15, "x" * 300000), (16, "x" * 300000), (0, "0123456789"), (-3, "0123456789"),
]


def test_one_build_equals_plain_python(spark):
    rows = EDGES + [(100 + i, t) for i, t in enumerate(texts(300, 1))]
    df = frame(spark, rows)
    assert got(ld.clean(ld.build_index(df), df)) == plain(rows)


def test_empty_table(spark):
    df = frame(spark, [])
    assert got(ld.clean(ld.build_index(df), df)) == []


def test_inserts_and_deletions_are_reversible(spark):
    parts = [[(100 * p + i, t) for i, t in enumerate(texts(60, 10 + p))] for p in range(3)]
    a, b, c = (frame(spark, p) for p in parts)
    index = ld.insert(ld.insert(ld.build_index(a), b), c)
    every = [r for p in parts for r in p]
    assert got(ld.clean(index, frame(spark, every))) == plain(every)
    # The first part goes: what remains is as if it had never been there, in every table.
    less = ld.delete(index, a.select("doc_id"))
    rest = parts[1] + parts[2]
    assert got(ld.clean(less, frame(spark, rest))) == plain(rest)
    scratch = ld.build_index(frame(spark, rest))
    assert got(less.counts.select("k1", "k2", "lo", "hi")) == got(scratch.counts.select("k1", "k2", "lo", "hi"))
    assert less.filters.agg({"held": "sum"}).first()[0] == scratch.filters.agg({"held": "sum"}).first()[0]
    # It comes back, and what does not exist is taken out.
    again = ld.delete(ld.insert(less, a), frame(spark, [(9999, "")]).select("doc_id"))
    assert got(ld.clean(again, frame(spark, every))) == plain(every)
    # The older index was not touched.
    assert got(ld.clean(index, frame(spark, every))) == plain(every)


def test_filter_holds_what_it_was_given():
    rng = np.random.default_rng(4)
    hashes = np.unique(rng.integers(-(1 << 62), 1 << 62, 60_000))
    stack = ld.FilterStack([])
    for part in np.array_split(hashes, 7):
        stack.add(part)
    assert stack.has(hashes).all() and sum(f.held for f in stack.filters) == len(hashes) and len(stack.filters) <= 5
    others = rng.integers(1 << 62, (1 << 63) - 1, 200_000)
    assert stack.has(others).mean() < 0.002
    stack.remove(hashes[::2])
    assert stack.has(hashes[1::2]).all() and stack.has(hashes[::2]).mean() < 0.002
    stack.remove(hashes[1::2])
    assert sum(f.held for f in stack.filters) == 0 and not any(f.cells.any() for f in stack.filters)


@pytest.mark.parametrize("load", [0.5, 0.8, 0.95])
def test_filter_refuses_rather_than_forgets(load):
    f = ld.CuckooFilter.sized(1)
    hashes = np.arange(1, int(f.cells.size * load) + 1, dtype=np.int64) * 7919
    refused = f.add(hashes, rounds=20)
    assert f.has(np.setdiff1d(hashes, refused)).all() and f.held == len(hashes) - len(refused)


def test_mistaken_keys_do_not_change_the_rows(spark, monkeypatch):
    """Fingerprints of one bit: nearly every key is taken for another, the exact counts settle it."""
    import pandas as pd

    rows = [(i, t) for i, t in enumerate(texts(40, 3, words=400))]
    places = ld.CuckooFilter._places
    monkeypatch.setattr(ld.CuckooFilter, "_places", lambda self, h: (lambda p, a, b: (np.ones_like(p), a, self._other(np.ones_like(p), a)))(*places(self, h)))
    refs = frame(spark, rows)
    seen = ld.line_refs(refs, 1).toPandas()
    seen = seen.assign(refs=1, lo=seen["doc_id"], hi=seen["doc_id"])[["shard", "k1", "k2", "refs", "lo", "hi"]]
    monkeypatch.setattr(ld, "STREAMED", 16)
    out = ld._through_filter((0,), seen, pd.DataFrame({"shard": [], "level": [], "held": [], "cells": []}))
    found = out[out["kind"] == "count"]
    exact = seen.groupby(["k1", "k2"])["lo"].agg(["min", "max"])
    exact = exact[exact["min"] != exact["max"]]
    assert sorted(zip(found["k1"], found["k2"], found["lo"], found["hi"])) == sorted((*k, a, b) for k, a, b in zip(exact.index, exact["min"], exact["max"]))
    assert out[out["kind"] == "filter"]["held"].sum() == seen["k1"].nunique()
