"""Near-duplicate groups against all pairs on a small corpus, and the signature's estimate."""

import random

import numpy as np
import pyarrow as pa

from stratapack.llm import neardup, shingles
from stratapack.llm.neardup import Params


def sets(texts, k):
    out = {}
    for d, t in texts:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").split()
        s = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
        out.setdefault(d, []).append(s)
    return out


def brute(texts, k):
    s = sets(texts, k)
    up = {d: d for d in s}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(s)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if any(100 * len(x & y) >= 80 * len(x | y) for x in s[a] for y in s[b] if x and y):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {d: root(d) for d in ids}


def corpus(seed, n=220):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    bases = [[rng.choice(vocab) for _ in range(rng.choice([5, 30, 80, 200]))] for _ in range(12)]
    out = []
    for d in range(n):
        kind = rng.random()
        if kind < 0.15:
            words = [rng.choice(vocab) for _ in range(rng.randint(1, 120))]
        else:  # edits of a few bases, also chains of them, from far under to far over the threshold
            words = list(rng.choice(bases if kind < 0.8 or not out else [t.split() for _, t in out if t] or bases))
            for _ in range(rng.randint(0, max(1, len(words) // rng.choice([8, 20, 40])))):
                words[rng.randrange(len(words))] = rng.choice(vocab)
        out.append((d * 3 + 1, " ".join(words).upper() if rng.random() < 0.1 else " ".join(words)))
    return out


def test_against_all_pairs(spark):
    for seed, k in ((1, 4), (2, 5)):
        texts = [*corpus(seed), (5000, None), (5001, ""), (5002, "one two"), (5003, "One  two"), (5003, "One  two"), (5004, " \n")]
        df = spark.createDataFrame([(*t, "x") for t in texts], "doc_id long, text string, component_id string")
        want, size = brute(texts, k), {d: len(s[0]) for d, s in sets(texts, k).items()}
        got = neardup.groups(spark, df, Params(words=k)).collect()
        assert len(got) == len(texts)
        for r in got:
            assert (r["component_id"], r["n_shingles"], r["kept"]) == (want[r["doc_id"]], size[r["doc_id"]], want[r["doc_id"]] == r["doc_id"])


def test_edges(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    got = {r["doc_id"]: (r["component_id"], r["kept"]) for r in neardup.groups(spark, df).collect()}
    assert got == {None: (None, True), 1: (1, True), 2: (1, False)}
    assert sorted(r["doc_id"] or 0 for r in neardup.keep_first(spark, df).collect()) == [0, 1]
    assert neardup.groups(spark, df.limit(0)).count() == 0


def test_estimate():
    rng = np.random.default_rng(3)
    for n in (1, 5, 60, 3000):
        errors = []
        for _ in range(30):
            x = rng.integers(0, 2**63, 2 * n, dtype=np.uint64)
            a, b = np.unique(x[: int(1.6 * n) or 1]), np.unique(x[int(0.4 * n) :])
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            errors.append((neardup.signature(a) == neardup.signature(b)).mean() - true)
        assert abs(np.mean(errors)) < 0.03


def test_every_slot_is_a_permutation_of_ranks():
    h = neardup.signature(np.array([12345], np.uint64))
    assert sorted((h >> np.uint64(32)).tolist()) == list(range(neardup.SLOTS))


def test_short_sequences_differ():
    s = shingles.shingle_sets(pa.array(["a b", "b a", "a b c d", "", "A  B"]), 4)
    assert s[0].tolist() == s[4].tolist() != s[1].tolist() and len(s[2]) == 1 and len(s[3]) == 0


def test_documents_of_several_texts(spark):
    """A doc_id that holds several texts links them all, far apart as they may be."""
    a, b, c = ("one two three four five six", "seven eight nine ten eleven twelve", "red green blue black white grey")
    rows = [(3, b), (7, a), (7, b), (9, a), (9, c), (11, c), (11, None), (12, ""), (12, None), (13, "alone in here with some words")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in neardup.groups(spark, df).collect())
    assert got == sorted((d, 3 if d < 12 else d, d in (3, 12, 13)) for d, _ in rows)
    assert sorted(r["doc_id"] for r in neardup.keep_first(spark, df).collect()) == [3, 12, 12, 13]
    texts = [(i % 90, t) for i, (_, t) in enumerate(corpus(5, 160))]
    want = brute(texts, 4)
    got = neardup.groups(spark, spark.createDataFrame(texts, "doc_id long, text string"), Params(words=4)).collect()
    assert all((r["component_id"], r["kept"]) == (want[r["doc_id"]], want[r["doc_id"]] == r["doc_id"]) for r in got)
