"""Toxicity, language ID and suffix-tree scores: held-out quality, brute force and odd inputs."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from starloom.llm import language_id, suffix_tree, toxicity
from starloom.llm.queries import op1_toxicity, op3_suffix_tree, op10_language_id

SF = "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (3, "   \n\t "), (4, "one"), (4, "one"), (None, "no id here"), (7, "12 34 !!"), (8, "word " * 60_000)]


def odd_docs(spark, extra=True):
    rows = [(i, t, "en", "x") for i, t in ODD]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    return docs if extra else docs.limit(0)


def test_toxicity_on_held_out_documents(spark):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = op1_toxicity(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [(labels[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    clean = [p for t, p in held if t == 0]
    assert sum(clean) <= 0.05 * len(clean)


def toxic_docs(spark):
    """Insults mark toxic texts; one group is named in most of them by chance."""
    texts = [("the women are idiot fools and trash" if i % 2 else "the women spoke to friends about the garden") if i % 3 else ("you idiot you trash" if i % 2 else "a garden with friends") for i in range(400)]
    texts = [t if i % 2 or "women" not in t or i % 4 else t.replace("women", "people") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, toxic int")
    return docs, labels


def test_swapped_groups_score_alike(spark):
    docs, labels = toxic_docs(spark)
    model = toxicity.fit(docs, labels)
    a, b, c = model.scores(["the women spoke", "the men spoke", "you idiot"])
    assert c > 0.9
    free = toxicity.fit(docs, labels, toxicity.Params(swap_penalty=0.0))
    x, y = free.scores(["the women spoke", "the men spoke"])
    assert abs(a - b) < 0.5 * abs(x - y) and abs(a - b) < 0.1


def test_toxicity_of_odd_inputs(spark):
    docs, labels = toxic_docs(spark)
    model = toxicity.fit(docs, labels)
    got = toxicity.with_score(odd_docs(spark), model).collect()
    assert len(got) == len(ODD) and all(0 <= r["toxicity_score"] <= 1 for r in got)
    assert toxicity.with_score(odd_docs(spark, False), model).count() == 0
    none = toxicity.fit(docs, labels.limit(0))
    assert none.scores(["you idiot", ""]).max() < 0.5
    odd_labels = spark.createDataFrame([(1, 1), (1, 1), (None, 0), (2, None), (3, 0)], "doc_id long, toxic int")
    assert toxicity.fit(docs, odd_labels) is not None


def test_language_on_held_out_documents(spark):
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op10_language_id(spark, SF).collect()
    assert len(rows) == len(langs)
    held = [r["lang_pred"] == langs[r["doc_id"]] for r in rows if r["held_out"]]
    assert np.mean(held) > 0.97 and all(0 <= r["score"] <= 1 for r in rows)
    assert np.mean([r["rejected"] for r in rows]) < 0.01


def language_docs(spark):
    rows = [(i, ("alpha beta gamma delta " * 20, "kiwi zuzu fofo wiki " * 20)[i % 2], ("aa", "zz")[i % 2]) for i in range(200)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_language_of_odd_inputs(spark):
    model = language_id.fit(language_docs(spark))
    got = {(r["doc_id"], r["text"] and r["text"][:12]): r["language"] for r in language_id.with_language(odd_docs(spark), model).collect()}
    for key in ((1, None), (2, ""), (3, "   \n\t "), (7, "12 34 !!")):
        assert got[key]["lang_pred"] == "und" and got[key]["rejected"] and got[key]["score"] == 0
    assert got[(8, "word word wo")]["lang_pred"] in ("aa", "zz")
    assert model.predict(["gamma delta alpha", "zuzu kiwi"])[0] == ["aa", "zz"]
    assert model.predict(["日本語の文章です" * 30])[2].tolist() == [True]
    empty = language_id.fit(language_docs(spark).limit(0))
    assert empty.predict(["abc"])[0] == ["und"]
    nulls = language_docs(spark).selectExpr("doc_id", "cast(null as string) as text", "lang")
    assert language_id.fit(nulls).predict(["abc"])[0] == ["und"]


def test_kneser_ney_sums_to_one_over_seen_characters():
    rows, _ = language_id.windows(["abba", "abac", "cab", "bac"], 4)
    grams, n = np.unique(rows, axis=0, return_counts=True)
    model = language_id.KneserNey(grams, n, 10)
    for context in ((0, 0, 2), (0, 2, 97), (2, 97, 98), (120, 121, 122)):
        seen = np.array([[*context, c] for c in np.unique(grams[:, -1])], "<u4")
        unseen = (10 - len(seen)) * model.probability(np.array([[*context, 5000]], "<u4"))[0]
        assert model.probability(seen).sum() + unseen == pytest.approx(1, abs=1e-9)


def test_base_scores_against_brute_force(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    count = Counter()
    for i, t in texts.items():
        if zlib.crc32(str(i).encode()) % 10:
            count.update([*t.encode().lower().split(), b"\n"])
    n, v = sum(count.values()), len(count)
    rows = op3_suffix_tree(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        words = [*texts[r["doc_id"]].encode().lower().split(), b"\n"]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(words), sum(count[w] > 0 for w in words), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words), rel=1e-9)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


class PlainTree:
    """The same tree in plain Python: counts of every context, kept by the divergence test, smoothed by the longest kept suffix."""

    def __init__(self, texts: list[bytes], params: suffix_tree.Params):
        self.params, self.root, self.counts, self.kept = params, Counter(), {}, {}
        for t in texts:
            padded = b" " * params.depth + t
            for i in range(params.depth, len(padded)):
                self.root[padded[i]] += 1
                for d in range(params.depth + 1):
                    self.counts.setdefault(padded[i - d:i], Counter())[padded[i]] += 1
        for context, seen in self.counts.items():
            total, shorter = sum(seen.values()), self.counts[context[1:]]
            gain = sum(n * math.log(n / total * sum(shorter.values()) / shorter[b]) for b, n in seen.items())
            if context and total >= params.least and gain >= params.divergence * len(seen):
                self.kept[context] = (seen, total)

    def probability(self, context: bytes, b: int) -> float:
        while context and context not in self.kept:
            context = context[1:]
        if not context:
            return (self.root[b] + 0.5) / (sum(self.root.values()) + 128)
        seen, total = self.kept[context]
        return (max(seen[b] - 0.5, 0) + 0.5 * len(seen) * self.probability(context[1:], b)) / total

    def log10(self, text: bytes) -> float:
        padded = b" " * self.params.depth + text
        return sum(math.log10(self.probability(padded[i - self.params.depth:i], padded[i])) for i in range(self.params.depth, len(padded)))


def spelled(text) -> bytes:
    return suffix_tree.spelled(suffix_tree.tokens_of(text or ""))


# Nothing is broadcast, some windows are, all are: the scores are the same.
@pytest.mark.parametrize("share", [2.0, 1e-3, 0.0])
def test_tree_scores_against_a_plain_tree(spark, share):
    sentences = ["the cat sat on the mat", "a dog ran over the mat", "no cat ran here", "Zebra crossing zebra", "na\u00efve caf\u00e9 \u65e5\u672c", "", None, "the cat sat on the mat"]
    docs = [(i, None if (s := sentences[i % len(sentences)]) is None else f"{s} {s[::-1] if i % 5 == 0 else s} w{i % 11}") for i in range(120)]
    params = suffix_tree.Params(depth=4, frequent=share, frequent_windows=share)
    rows = suffix_tree.score(spark.createDataFrame(docs, "doc_id long, text string"), params).collect()
    plain = PlainTree([spelled(t) for i, t in docs if zlib.crc32(str(i).encode()) % 10], params)
    texts = dict(docs)
    assert len(rows) == len(docs) and any(r["held_out"] for r in rows)
    assert sum(plain.probability(b" cat", b) for b in range(256)) == pytest.approx(1, abs=1e-9)
    for r in rows:
        assert r["score"] == pytest.approx(plain.log10(spelled(texts[r["doc_id"]])), rel=1e-9)


def test_query_scores_against_a_plain_tree(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    plain = PlainTree([spelled(t) for i, t in texts.items() if zlib.crc32(str(i).encode()) % 10], suffix_tree.Params())
    for r in op3_suffix_tree(spark, SF).collect():
        assert r["score"] == pytest.approx(plain.log10(spelled(texts[r["doc_id"]])), rel=1e-9)


def test_the_tree_grows_with_the_corpus(spark):
    """New texts add contexts, however much is there already: a word seen twice in a large corpus is kept."""
    frame = lambda rows: spark.createDataFrame(rows, "text string, held_out boolean")
    common = [("the cat sat on the mat and the dog ran to the mat " * 20, False)] * 50
    small, large = suffix_tree.fit(frame(common)).contexts, suffix_tree.fit(frame(common + [("qyxowz", False)] * 2 + [("vukejb", True)] * 2)).contexts
    new = large.join(small, ["depth", "context"], "left_anti")
    assert new.where("total = 2").count() >= 6
    assert small.join(large, ["depth", "context"], "left_anti").where("depth = 5").count() == 0


def test_tree_of_odd_inputs(spark):
    rows = suffix_tree.score(odd_docs(spark)).collect()
    assert len(rows) == len(ODD) and all(math.isfinite(r["score"]) and math.isfinite(r["base_score"]) for r in rows)
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["n_tokens"] == by[2]["n_tokens"] == by[3]["n_tokens"] == 1 and by[8]["n_tokens"] == 60_001
    assert suffix_tree.score(odd_docs(spark, False)).count() == 0


def test_suffix_tree_distinct_windows_are_sorted_not_hashed(monkeypatch):
    """Scoring finds its windows by a sort; hashing them was the largest part of its CPU time."""
    draw = np.random.default_rng(3)
    for n in (0, 1, 2, 10_000):
        keys = draw.integers(-5, n // 3 + 2, n)
        assert np.array_equal(suffix_tree.distinct_of(keys), np.unique(keys))
    plain, bare = np.unique, []
    monkeypatch.setattr(np, "unique", lambda x, **kw: (bare.append(1) if not kw else None, plain(x, **kw))[1])
    suffix_tree._known_windows([b"some words \n", b"\n"], 3, np.zeros(0, np.int64), np.zeros(0))
    assert not bare
