"""Fields, classifiers and rules: exact inference by brute force, held-out accuracy, and defined results for odd rows."""

import itertools
import random
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.llm import crf
from tessera.llm.labelled import held_out, without_copies
from tessera.llm.quality_crf import quality
from tessera.llm.quality_rules import quality_rules
from tessera.llm.toxicity import toxicity

DATA = "/root/testdata/sf0.01"
DOC = "doc_id long, text string"
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "word"), (4, "word"), (5, "é☃ " * 4000)]


@pytest.mark.parametrize("n", [1, 2, 5, 8])
def test_marginals_equal_enumeration(n):
    rng = np.random.default_rng(n)
    chain, emission = crf.Chain(rng.normal(size=(2, 2)), rng.normal(size=2)), rng.normal(size=n)
    begins = np.zeros(n, bool)
    begins[[0, n // 2]] = True
    total, one, pairs = 0.0, np.zeros(n), np.zeros((2, 2))
    for labels in itertools.product((0, 1), repeat=n):
        score = sum(emission[t] * y + (chain.first[y] if begins[t] else chain.transition[labels[t - 1], y]) for t, y in enumerate(labels))
        weight = np.exp(score)
        total += weight
        one += weight * np.array(labels)
        for t in range(1, n):
            if not begins[t]:
                pairs[labels[t - 1], labels[t]] += weight
    got, joint = chain.marginals(emission, begins, pairs=True)
    assert np.allclose(got, one / total) and np.allclose(joint, pairs / total)


def test_long_streams_equal_short_ones():
    rng = np.random.default_rng(0)
    chain, emission = crf.Chain(rng.normal(size=(2, 2)), rng.normal(size=2)), rng.normal(size=5000) * 3
    begins = rng.random(5000) < 0.01
    begins[0] = True
    cuts = [*np.flatnonzero(begins), 5000]
    parts = [chain.marginals(emission[s:e], begins[s:e]) for s, e in itertools.pairwise(cuts)]
    assert np.allclose(chain.marginals(emission, begins), np.concatenate(parts))


@pytest.mark.parametrize(("operator", "label", "least"), [(toxicity, "toxic", 0.93), (quality, "quality", 0.95)])
def test_held_out_accuracy_and_odd_rows(spark, operator, label, least):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    wide = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(d + 10**6, t) for d, t in ODD], DOC)).withColumn("score", F.lit("clash"))
    got = operator(wide, labels).join(labels, "doc_id", "left").toPandas()
    assert len(got) == docs.count() + len(ODD) and got["score"].between(0, 1).all()
    assert (got["held_out"] == got["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    test = got[got["held_out"] & got[label].notna()]
    assert (test["predicted"] == test[label]).mean() >= least
    assert got[got["doc_id"] == 10**6 + 4]["score"].nunique() == 1
    assert got[got["doc_id"].isin([10**6 + 1, 10**6 + 2, 10**6 + 3])]["score"].nunique() == 1


def test_spans_are_offsets_of_the_words(spark):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("äbcdeü") for _ in range(5))
    rows = [(i, f"{word()} {word()} {word()} {'SCUMbag' if i % 2 else word()}, {word()} {word()} {word()}") for i in range(400)]
    docs = spark.createDataFrame(rows, DOC)
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, toxic int")
    for r in toxicity(docs, labels).join(docs, "doc_id").where("doc_id < 20").collect():
        assert [r["text"][s["start"] : s["end"]] for s in r["spans"]] == (["SCUMbag"] if r["doc_id"] % 2 else [])


def plain_marginals(emission, chain):
    """P(label 1) of each item of one sequence, by sums over logarithms."""
    n = len(emission)
    score = [[0.0, float(e)] for e in emission]
    ahead, behind = [[chain.first[y] + score[0][y] for y in (0, 1)]], [[0.0, 0.0]]
    for t in range(1, n):
        ahead.append([score[t][y] + np.logaddexp(*(ahead[-1][x] + chain.transition[x, y] for x in (0, 1))) for y in (0, 1)])
    for t in range(n - 1, 0, -1):
        behind.append([np.logaddexp(*(chain.transition[x, y] + score[t][y] + behind[-1][y] for y in (0, 1))) for x in (0, 1)])
    behind.reverse()
    return np.array([1 / (1 + np.exp(a[0] + b[0] - a[1] - b[1])) for a, b in zip(ahead, behind, strict=True)])


def sigmoid(columns, document):
    w, mean, scale = document
    return 1 / (1 + np.exp(-(((np.array(columns) - mean) / scale * w[:-1]).sum() + w[-1])))


def learned(label):
    import duckdb

    return duckdb.sql(f"SELECT text, {label} AS label FROM '{DATA}/documents.parquet' JOIN '{DATA}/labels.parquet' USING (doc_id) WHERE {label} IN (0, 1) AND text IS NOT NULL ORDER BY doc_id LIMIT 250").df()


def scored(module, model, texts):
    import pyarrow as pa

    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    return [r for b in module._scored(iter([batch]), model) for r in b.to_pylist()]


def test_toxicity_scores_and_spans_equal_a_plain_model():
    import re

    from tessera.llm import toxicity as module

    rows = learned("toxic")
    model, texts = module.train(rows, rounds=8), [*rows["text"][:60], "one", "", "é words, and \n more"]
    hot = 0
    for text, got in zip(texts, scored(module, model, texts), strict=True):
        words = [(m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
        if not words:
            assert got["spans"] == [] and abs(got["score"] - sigmoid([0, 0, 0], model.document)) < 1e-8
            continue
        own = np.array([module.features(np.frombuffer(text[s:e].encode(), np.uint8), np.array([0, len(text[s:e].encode())]))[3][0] for s, e in words])
        part = module._PART
        emission = [float(model.bias[0]) + sum(float(model.weights[f]) for f in o) + (float(model.weights[part + own[i - 1][0]]) if i else 0) + (float(model.weights[2 * part + own[i + 1][0]]) if i + 1 < len(own) else 0) for i, o in enumerate(own)]
        marginal = plain_marginals(emission, model.chain)
        columns = [np.log1p(marginal.sum()), marginal.max(), np.sqrt(marginal.sum() / len(marginal))]
        assert abs(got["score"] - sigmoid(columns, model.document)) < 1e-5
        if (abs(marginal - 0.5) > 1e-4).all():
            runs = [i for i in range(len(marginal)) if marginal[i] >= 0.5 and (i == 0 or marginal[i - 1] < 0.5)]
            assert len(got["spans"]) == len(runs)
            assert all(words[i][0] <= s["start"] < words[i][1] for i, s in zip(runs, got["spans"], strict=True))
            hot += len(runs)
    assert hot


def test_quality_scores_equal_a_plain_model():
    from tessera.llm import quality_crf as module

    rows = learned("quality")
    model, texts = module.train(rows, rounds=20), [*rows["text"][:60], "one line", "", "two\nlines of it"]
    for text, got in zip(texts, scored(module, model, texts), strict=True):
        data = np.frombuffer(text.encode(), np.uint8)
        own, _, length = module.features(data, np.array([0, len(data)]))
        if not len(own):
            assert got["line_scores"] == []
            continue
        zero = np.zeros(own.shape[1])
        emission = [float(np.concatenate([own[i], own[i - 1] if i else zero, own[i + 1] if i + 1 < len(own) else zero]) @ model.weights) for i in range(len(own))]
        marginal = plain_marginals(emission, model.chain)
        assert np.allclose(got["line_scores"], marginal, atol=1e-6)
        mean = np.clip((marginal * length).sum() / length.sum(), 1e-4, 1 - 1e-4)
        assert abs(got["score"] - sigmoid([np.log(mean / (1 - mean)), 1.0], model.document)) < 1e-5


def test_samples_are_bounded_in_rows(spark):
    from tessera.llm.labelled import sample

    a, b, c = [i for i in range(50) if zlib.crc32(str(i).encode()) % 4 != 2][:3]
    docs = spark.createDataFrame([(a, f"text {i}") for i in range(500)] + [(b, "good"), (None, "none")], DOC)
    labels = spark.createDataFrame([(a, 1), (b, 0), (c, 0)], "doc_id long, toxic int")
    rows = sample(docs, labels, "toxic", per_class=2, max_chars=100)
    assert sorted(zip(rows["text"], rows["label"], strict=True)) == [("good", 0), ("text 0", 1)]


def test_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    for operator in (toxicity, quality):
        assert len({r["score"] for r in operator(spark.createDataFrame([(1, "a b"), (2, "a b")], DOC), none).collect()}) == 1
        assert operator(spark.createDataFrame([], DOC), none).collect() == []


def test_held_out_rows(spark):
    got = spark.range(200).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 4 == 2) for r in got)


def test_copies_are_dropped_from_a_sample():
    words = [f"w{i}" for i in range(100)]
    rows = pd.DataFrame({"text": [" ".join(words), " ".join([*words[:50], "x", *words[51:]]), "other words here that are not the same"], "label": [1, 1, 0]})
    assert list(without_copies(rows).index) == [0, 2]


def brute_rules(text):
    import collections
    import re

    text, word = text or "", re.compile(r"[^\x20\x09-\x0D]+")
    w = word.findall(text)
    times = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if times[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if word.search(line):
            repeated += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in text), repeated, len(covered)


def test_rules_equal_brute_force(spark):
    import math

    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").where("doc_id < 150").select("doc_id", "text").collect()]
    docs += [(10**6 + i, t) for i, (_, t) in enumerate(ODD)] + [(2 * 10**6, "a b c d e f g h i " * 9 + "\nx\nx\n \n"), (2 * 10**6 + 1, "q " * 15 + "\x0bz"), (3 * 10**6, "w " * 30000)]
    trusted = [(d,) for d, _ in docs if d % 2]
    got = quality_rules(spark.createDataFrame(docs, DOC).withColumn("n_words", F.lit(1)), spark.createDataFrame(trusted, "doc_id long"), buckets=512, threshold=0.0).collect()
    by_id = {r["doc_id"]: r for r in got}
    assert len(got) == len(docs)
    for d, t in docs:
        r, want = by_id[d], brute_rules(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, d
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert r["kept"] == (not r["base_failed"] and r["score"] >= 0.0) and math.isfinite(r["score"])
    assert quality_rules(spark.createDataFrame([], DOC), spark.createDataFrame([], "doc_id long"), buckets=16).collect() == []


def test_scores_are_mean_log_ratios(spark):
    import collections
    import math

    texts = {1: "a b a", 2: "c d", 3: "a c"}
    docs = spark.createDataFrame(list(texts.items()), DOC)
    hashed = spark.sql("SELECT w, xxhash64(w) AS h FROM VALUES ('a'), ('b'), ('c'), ('d') t(w)").collect()
    h = {r["w"]: r["h"] for r in hashed}
    grams = {}
    for d, t in texts.items():
        w = [h[x] for x in t.split()]
        pairs = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(itertools.pairwise(w))], "i int, a long, b long").select("i", F.xxhash64("a", "b").alias("h")).orderBy("i").collect()
        grams[d] = [x % 8 for x in w + [p["h"] for p in pairs]]
    raw, target = collections.Counter(sum(grams.values(), [])), collections.Counter(grams[1])
    ratio = {b: math.log((target[b] + 1) / (target.total() + 8) / ((raw[b] + 1) / (raw.total() + 8))) for b in range(8)}
    for r in quality_rules(docs, spark.createDataFrame([(1,)], "doc_id long"), buckets=8).collect():
        assert math.isclose(r["score"], sum(ratio[b] for b in grams[r["doc_id"]]) / len(grams[r["doc_id"]]), abs_tol=1e-12)
