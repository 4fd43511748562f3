"""SimHash groups, benchmark overlaps and the pipeline against brute force."""

import math
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from starloom.llm import decontaminate, queries, simhash
from tests.llm.test_text_models import ODD, SF, odd_docs


def find(p, x):
    while p[x] != x:
        p[x] = p[p[x]]
        x = p[x]
    return x


def slow_print(text, n=3):
    words = text.encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + n]) for i in range(len(words) - n + 1)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(prints, radius):
    ids = list(prints)
    a = np.array([prints[i] for i in ids], np.uint64)
    p = list(range(len(ids)))
    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= radius).tolist():
            p[find(p, j)] = find(p, i)
    least = {}
    for i, d in enumerate(ids):
        r = find(p, i)
        least[r] = min(least.get(r, d), d)
    return {d: least[find(p, i)] for i, d in enumerate(ids)}


def test_components_against_brute_force(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in queries.op6_simhash(spark, SF).collect()}
    prints = {d: slow_print(t) for d, t in texts.items()}
    assert {d: r["fingerprint"] for d, r in got.items()} == {d: f"{x:016x}" for d, x in prints.items()}
    assert {d: r["component_id"] for d, r in got.items()} == slow_components(prints, 2)


@pytest.mark.parametrize("tile", [8, 8192])
def test_no_link_is_lost_among_close_prints(spark, tile):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 6, dtype=np.uint64)
    prints = {int(b) ^ int(sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 6), False))) for b in base for _ in range(60)}
    items = spark.createDataFrame([(f"{x:016x}", 5) for x in prints], "fingerprint string, shingles long")
    links = simhash.spanning_links(items, simhash.Params(tile=tile)).collect()
    numbered = {i: x for i, x in enumerate(sorted(prints))}
    number = {f"{x:016x}": i for i, x in numbered.items()}
    p = list(range(len(numbered)))
    for r in links:
        a, b = number[r["source_id"]], number[r["target_id"]]
        assert (numbered[a] ^ numbered[b]).bit_count() <= 2
        p[find(p, a)] = find(p, b)
    want = slow_components(numbered, 2)
    groups = defaultdict(set)
    for i in numbered:
        groups[find(p, i)].add(i)
    assert {frozenset(g) for g in groups.values()} == {frozenset(i for i in want if want[i] == c) for c in set(want.values())}


@pytest.mark.parametrize("tile", [16, 8192])
def test_wide_cells_see_every_pair(spark, tile):
    rng = np.random.default_rng(4)
    base = [int(x) for x in rng.integers(0, 2**63, 8, dtype=np.uint64)]
    items = {}
    for k in range(240):
        x = base[k % 8] ^ sum(1 << int(b) for b in rng.choice(64, int(rng.integers(0, 9)), False))
        items[f"{x:016x}"] = int(rng.integers(50, 200))
    params = simhash.Params(radius=8, ratio=0.8, tile=tile)
    df = spark.createDataFrame(list(items.items()), "fingerprint string, shingles long")
    names = list(items)
    p, q = ({n: n for n in names} for _ in range(2))
    for r in simhash.spanning_links(df, params).collect():
        p[find(p, r["source_id"])] = find(p, r["target_id"])
    for a in names:
        for b in names:
            n, m = sorted((items[a], items[b]))
            if (int(a, 16) ^ int(b, 16)).bit_count() <= 8 and n >= 0.8 * m:
                q[find(q, a)] = find(q, b)
    parts = lambda f: {frozenset(n for n in names if find(f, n) == r) for r in {find(f, n) for n in names}}
    assert parts(p) == parts(q)


def test_prints_of_odd_inputs(spark):
    got = simhash.near_groups(odd_docs(spark)).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(d for d, _ in ODD)
    empty = [r for r in got if r["doc_id"] in (1, 2, 3)]
    assert {(r["fingerprint"], r["component_id"]) for r in empty} == {("0" * 16, 1)}
    assert simhash.near_groups(odd_docs(spark, False)).count() == 0


def near_docs(spark, folder):
    rng = np.random.default_rng(8)
    words = np.array([f"w{k}" for k in range(3_000)])
    data = []
    for g in range(40):
        first = rng.choice(words, int(rng.integers(60, 400)))
        data.append((10 * g, " ".join(first)))
        near = first.copy()
        near[int(rng.integers(5, len(near) - 5))] = "changed"
        data.append((10 * g + 1, " ".join(near)))
        far = first.copy()
        far[::9] = "other"  # no five words in a row stay often enough
        data.append((10 * g + 2, " ".join(far)))
        data.append((10 * g + 3, " ".join(first).upper()))
    data += [(1000, None), (1001, ""), (None, "lonely text of six words here"), (1003, "lonely text of six words here")]
    spark.createDataFrame(data, "doc_id long, text string").selectExpr("*", "'en' as lang", "'s' as source", "10L as n_chars").repartition(3).write.parquet(folder)
    return spark.read.parquet(folder)


def test_one_of_each_group_stays(spark, tmp_path):
    kept = Counter(r["doc_id"] for r in simhash.first_of_groups(near_docs(spark, str(tmp_path / "d"))).collect())
    for g in range(40):
        assert sum(kept[10 * g + k] for k in (0, 1, 3)) == 1 and kept[10 * g + 2] == 1
    assert kept[1000] + kept[1001] == 1 and kept[None] + kept[1003] == 1


@pytest.mark.parametrize("block", [512, 7])
def test_refuted_links_hide_no_other(spark, monkeypatch, tmp_path, block):
    """Families of texts about as similar as asked: the forest's links are often refuted."""
    monkeypatch.setattr(simhash, "BLOCK_ITEMS", block)
    rng = np.random.default_rng(11)
    words = np.array([f"w{k}" for k in range(2_000)])
    data = []
    for g in range(12):
        first = rng.choice(words, int(rng.integers(120, 300)))
        for k in range(25):
            text = first.copy()
            change = rng.choice(len(text), int(len(text) * rng.uniform(0.01, 0.035)), False)
            text[change] = rng.choice(words, len(change))
            data.append((100 * g + k, " ".join(text)))
    spark.createDataFrame(data, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    got = {r["doc_id"]: r for r in simhash.near_groups(spark.read.parquet(str(tmp_path / "d")), simhash.SIMILAR).collect()}
    sets = {d: set(simhash.shingle_hashes(t, 5).tolist()) for d, t in data}
    p, refuted = {d: d for d in sets}, 0
    for i, a in enumerate(sets):
        for b in list(sets)[:i]:
            n, m = sorted((len(sets[a]), len(sets[b])))
            if (int(got[a]["fingerprint"], 16) ^ int(got[b]["fingerprint"], 16)).bit_count() <= simhash.SIMILAR.radius and n >= 0.8 * m:
                if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    p[find(p, max(find(p, a), find(p, b)))] = min(find(p, a), find(p, b))
                else:
                    refuted += 1
    assert refuted > 100
    assert {d: r["component_id"] for d, r in got.items()} == {d: find(p, d) for d in p}


def test_no_similar_pair_lies_beyond_reach(spark, tmp_path):
    """Pairs right at the similarity asked for, of short and long texts; brute force by Jaccard alone."""
    reach = simhash.reach(0.8, 256)
    assert max(reach) == simhash.SIMILAR.radius and simhash.differing(5, 4, 4) == 0.1875
    for n, m, both in ((90, 90, 80), (180, 180, 160), (181, 181, 161), (100, 80, 80), (101, 81, 81), (900, 900, 800)):
        p = simhash.differing(n, m, both)
        assert sum(math.comb(256, k) * p**k * (1 - p) ** (256 - k) for k in range(int(reach[-1]) + 1, 257)) < simhash.LOST
    data = []
    for g in range(400):
        n = (9, 9, 19, 29)[g % 4]
        words = [f"g{g}w{k}" for k in range(n)]
        data += [(2 * g, " ".join(words)), (2 * g + 1, " ".join(words[:n - (n - 4) // 5]))]
    spark.createDataFrame(data, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_groups(spark.read.parquet(str(tmp_path / "d")), simhash.SIMILAR).collect()}
    sets = {d: set(simhash.shingle_hashes(t, 5).tolist()) for d, t in data}
    p = {d: d for d in sets}
    for a in sets:
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                p[find(p, a)] = find(p, b)
    assert got == {d: find(p, d) for d in p} and set(got.values()) == set(range(0, 800, 2))


def test_overlaps_forgive_substitutions(spark):
    rng = np.random.default_rng(2)
    words = [f"b{k}" for k in range(2_000)]
    items = [" ".join(rng.choice(words, 40)) for _ in range(20)]
    bench = spark.createDataFrame([*[(i, t) for i, t in enumerate(items)], (50, items[0]), (51, "tiny item of five words"), (52, None), (53, "")], "item_id long, text string")
    noise = lambda n: " ".join(f"n{k}" for k in rng.integers(0, 50_000, n))
    docs = []
    for i, t in enumerate(items):
        w = t.split()
        spoiled = w.copy()
        spoiled[20] = spoiled[33] = "zzz"
        docs += [(10 * i, f"{noise(30)} {t.upper()}, {noise(20)}"), (10 * i + 1, f"{noise(9)} {' '.join(spoiled)} {noise(5)}"), (10 * i + 2, f"{noise(15)} {' '.join(w[10:30])} {noise(15)}"),
                 (10 * i + 3, f"{noise(15)} {' '.join(w[:8])} {noise(15)}"), (10 * i + 4, noise(80))]
    docs += [(900, "well, TINY item: of five words!"), (901, None), (902, ""), (None, f"{noise(5)} {items[3]}")]
    table = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as item_id")
    got = decontaminate.contamination(table, bench).collect()
    hit = {(r["doc_id"], r["item_id"]) for r in got}
    assert hit == {(10 * i + k, i) for i in range(20) for k in (0, 1, 2)} | {(900, 51), (None, 3)}
    whole = {r["doc_id"]: r for r in got if r["doc_id"] is not None and r["doc_id"] % 10 == 1}
    assert all((r["span"], r["equal_words"], r["doc_start"], r["item_start"]) == (40, 38, 9, 0) for r in whole.values())
    clean = decontaminate.clean(table, bench)
    assert clean.columns == table.columns
    assert {r["doc_id"] for r in clean.collect()} == {d for d, _ in docs} - {d for d, _ in hit}
    assert decontaminate.clean(table, bench.limit(0)).count() == len(docs)
    assert decontaminate.contamination(table.limit(0), bench).count() == 0


def test_seeds_cover_any_single_substitution():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 2**63, 12, dtype=np.uint64)
    for k in range(12):
        g = h.copy()
        g[k] ^= np.uint64(1)
        assert any(a[0] == b[0] for a, b in zip(decontaminate.seeds(h), decontaminate.seeds(g), strict=True))


def test_masks_hit_every_pattern_of_substitutions():
    """Stretches of 26 words or more have a part of 13 to 25 with the same share."""
    for length in range(1, 26):
        masks = decontaminate.masks(length)
        missed = np.array([sum(1 << i for i in c) for c in combinations(range(length), length // 5)], np.int64)
        for m in masks:
            bits = sum(1 << i for i in m)
            for start in range(length - m[-1]):
                missed = missed[missed & (bits << start) != 0]
        assert not len(missed), length


def qualifies(doc, item, least=13):
    """Whether any stretch of any diagonal counts."""
    least = min(least, len(item))
    for diagonal in range(-len(item), len(doc) + 1):
        same = [doc[i + diagonal] == item[i] for i in range(len(item)) if 0 <= i + diagonal < len(doc)]
        if any(5 * sum(same[i:j]) >= 4 * (j - i) for i in range(len(same)) for j in range(i + least, len(same) + 1)):
            return True
    return False


def test_every_stretch_that_counts_is_found(spark):
    rng = np.random.default_rng(5)
    items, docs = [], []
    for k in range(150):
        n = int(rng.integers(13, 25)) if k < 120 else int(rng.integers(5, 13))
        item = [f"i{k}x{j}" for j in range(n)]
        doc = item.copy()
        for at in rng.choice(n, int(rng.integers(2, 5)) if k < 120 else int(rng.integers(1, 4)), False):
            doc[at] = "zzz"
        items.append(item)
        docs.append([f"n{j}" for j in range(k % 4)] + doc + ["end"] * (k % 3))
    long = [f"long{j}" for j in range(59)]
    items.append(long)
    docs.append([w if j % 5 != 4 else "zzz" for j, w in enumerate(long)])  # 48 of 59
    run = [f"run{j}" for j in range(60)]
    items.append(run)
    docs.append([*run[:12], "noise", "noise", "noise", *(w if j % 5 != 2 else "zzz" for j, w in enumerate(run[15:40]))])  # a shorter stretch has the better balance
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    table = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(docs)], "doc_id long, text string")
    want = {i for i, (d, x) in enumerate(zip(docs, items, strict=True)) if qualifies(d, x)}
    got = decontaminate.contamination(table, bench).collect()
    assert {150, 151} <= want and 20 < len(want) < len(docs)
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(i, i) for i in want}
    assert {r["doc_id"] for r in decontaminate.clean(table, bench).collect()} == set(range(len(docs))) - want
    with pytest.raises(ValueError):
        decontaminate.clean(table, bench, decontaminate.Params(least=8))


def test_query_finds_every_shared_run(spark):
    texts = {r["doc_id"]: decontaminate.WORD.findall(r["text"].lower()) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    bench = [decontaminate.WORD.findall(r["text"].lower()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    runs = {tuple(b[i:i + 13]) for b in bench for i in range(len(b) - 12)}
    want = {d for d, w in texts.items() if any(tuple(w[i:i + 13]) in runs for i in range(len(w) - 12))}
    got = {r["doc_id"] for r in queries.op7_decontamination(spark, SF).collect()}
    assert want and got == want


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language", "near-dedup", "decontamination", "packing"]
    held = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.written(stage(spark, held, SF), f"test-{name}")
        assert out.columns == docs.columns and out.join(held.select("doc_id"), "doc_id", "left_anti").isEmpty()
        assert 0.5 * held.count() < out.count() <= held.count()
        held = out
    packed = corpus_pipeline.STAGES[-1][1](spark, held, SF).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in held.select("doc_id").collect()}
    assert len(packed) == len({(r["doc_id"], r["piece"]) for r in packed})


def test_pipeline_of_odd_documents(spark, tmp_path):
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    odd = odd_docs(spark).selectExpr("doc_id", "text", "cast(null as string) as lang", "cast(null as string) as source", "cast(null as long) as n_chars")
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0  # without a learned language all are rejected
    odd.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/none/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{tmp_path}/none/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
