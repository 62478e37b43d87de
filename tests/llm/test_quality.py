"""The classifier's held-out accuracy and its edge cases."""

import dataclasses
import math
import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from stratapack.llm import quality

SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.train(docs, labels)
    out = quality.score_documents(spark, docs, model)
    assert out.count() == docs.count()
    met = [r for r in out.join(labels, "doc_id").collect() if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in met)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in met)
    assert sum(r["predicted"] == r["quality"] for r in met) >= 0.97 * len(met)


def test_edges(spark):
    rows = [(1, "good words here", "a"), (1, "good words here", "a"), (2, None, None), (3, "", "b"), (4, "x" * 200_000, "c"), (None, "bad", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    out = quality.score_documents(spark, docs, quality.train(docs, none)).collect()
    assert len(out) == 6 and all(r["score"] == 0.5 for r in out)
    labels = spark.createDataFrame([(1, 1), (1, None), (3, 0), (4, 0), (9, 1)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    assert quality.score_documents(spark, docs.limit(0), model).count() == 0
    assert quality.keep_good(spark, docs, model).columns == docs.columns


def brute_score(m, text):
    """A text's score feature by feature: words, padded character n-grams, pairs and class pairs."""
    p, mask = m.params, (1 << 64) - 1

    def mix(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ x >> 27) * 0x94D049BB133111EB & mask
        return x ^ x >> 31

    row = lambda h: h % p.buckets + p.classes**2
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    hashes, found = [], []
    for w in words:
        h, power = 0, 1
        for c in w:
            power = power * 1099511628211 & mask
            h = h + (ord(c) + 1) * power & mask
        hashes.append(mix(h))
        found.append(row(hashes[-1]))
        points = [0, *map(ord, w), 0]
        for k in p.grams:
            for i in range(len(points) - k + 1):
                h = k
                for c in points[i : i + k]:
                    h = h * 1000003 + c & mask
                found.append(row(mix(h)))
    for a, b in zip(hashes, hashes[1:]):
        found.append(row(mix(a * int(quality.GOLDEN) + b & mask)))
        found.append((a >> 40) % p.classes * p.classes + (b >> 40) % p.classes)
    z = (sum(m.weights[f] for f in found) / len(found) if found else 0) + m.bias
    return 1 / (1 + math.exp(-z))


def test_scores_against_brute_force():
    texts = ["one two  one\tone", "éa ß 漢字 \U0001f600x", "", " \n", "a", "x x x x", "b\u00a0c d" * 40]
    m = quality.fit(texts, [1, 0, 1, 0, 1, 0, 1], quality.Params(least_steps=200))
    assert np.allclose(m.score(pa.array(texts)), [brute_score(m, t) for t in texts], atol=1e-9)
    sliced = pa.array(["zz", *texts])[1:]
    assert np.allclose(m.score(sliced), m.score(pa.array(texts)))


def auc(score, label):
    good, bad = score[label == 1], score[label == 0]
    return np.mean([(g > bad).mean() + (g == bad).mean() / 2 for g in good])


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="needs the test tables")
def test_every_kind_of_feature_counts():
    """Held-out AUC, and what is left of it when one kind of features is taken out of the same model."""
    docs, marks = (pq.read_table(f"/root/testdata/sf0.1/{t}.parquet").to_pydict() for t in ("documents", "labels"))
    label = dict(zip(marks["doc_id"], marks["quality"]))
    rows = [(zlib.crc32(str(i).encode()) % 4 == 2, t, label[i]) for i, t in zip(docs["doc_id"], docs["text"]) if i in label and t]
    fitted = [r for r in rows if not r[0] and len(r[1]) < 20_000][:2000]
    m = quality.fit([r[1] for r in fitted], [r[2] for r in fitted])
    held, y = pa.array([r[1] for r in rows if r[0]]), np.array([r[2] for r in rows if r[0]])
    whole = auc(m.score(held), y)
    assert whole >= 0.99
    pairs = np.arange(len(m.weights)) < m.params.classes**2
    for gone in (pairs, ~pairs):
        assert 0.6 <= auc(dataclasses.replace(m, weights=np.where(gone, 0, m.weights)).score(held), y) < whole


def test_repeats_and_empty_texts():
    m = quality.fit(["a b c d", "x x x x", "e f g h", "y y y"], [1, 0, 1, 0])
    s = m.score(pa.array(["a b c d", "x x x x x", "", "  "]))
    assert s[0] > s[1] and s[2] == s[3]
