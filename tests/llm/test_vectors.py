"""Both vector searches against brute force."""

import os

import numpy as np
import pyarrow.parquet as pq
import pytest

from stratapack.llm import maxscore, multiindex
from stratapack.llm.maxscore import Shard

EMPTY = "vec_id long, embedding array<float>, score string"


def clusters(n, d=16, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, d))
    return (centres[rng.integers(0, 8, n)] + 0.4 * rng.normal(size=(n, d))).astype(np.float32)


def frame(spark, x, more=()):
    return spark.createDataFrame([(i, [float(v) for v in r], "q") for i, r in enumerate(x)] + list(more), EMPTY)


ODD = [(9001, None, "q"), (9002, [], "q"), (9003, [float("nan")] + [1.0] * 15, "q"), (9004, [float("inf")] + [1.0] * 15, "q"), (9005, [None] + [1.0] * 15, "q"), (9006, [1.0] * 3, "q"), (None, [1.0] * 16, "q")]


def test_multiindex_recall(spark):
    x = clusters(3000).astype(float)
    p = multiindex.Params(centroids=48, share=0.13, bin_rows=100)
    got = multiindex.search(spark, frame(spark, x.astype(np.float32), [*ODD, (9007, [0.0] * 16, "q")]), lambda i: i % 100 == 0, p=p).toPandas()
    hit = 0
    for q in range(0, 3000, 100):
        s = np.sqrt(((x - x[q]) ** 2).sum(1))
        want = [i for i in np.lexsort((np.arange(3000), s)) if i != q][:10]
        mine = got[got.query_id == q].sort_values("rank")
        assert list(mine["rank"]) == list(range(1, 11)) and np.allclose(mine.score, s[mine.vec_id])
        assert list(zip(mine.score, mine.vec_id)) == sorted(zip(mine.score, mine.vec_id))
        hit += len(set(want) & set(mine.vec_id))
    assert hit >= 0.9 * 300


def test_multiindex_hot_vector_and_ties(spark):
    x = clusters(600)
    x[100:500] = x[100]  # two thirds are one vector
    p = multiindex.Params(bin_rows=64)
    got = multiindex.search(spark, frame(spark, x), lambda i: i % 100 == 0, p=p).toPandas()
    assert list(got[got.query_id == 200].sort_values("rank").vec_id) == list(range(100, 110))


@pytest.mark.parametrize("d", [1, 16])
def test_maxscore_exact(spark, d):
    x = clusters(700, d)
    x[300:420] = x[300]
    more = ODD if d == 16 else []
    p = maxscore.Params(least_rows=50, spread=5, block_rows=3)
    got = maxscore.search(spark, frame(spark, x, more), lambda i: i % 100 == 0, p=p).toPandas()
    y = np.floor(x.astype(float) * 1024).astype(int)
    for q in range(0, 700, 100):
        s = y @ y[q]
        want = [i for i in np.lexsort((np.arange(700), -s)) if i != q][:10]
        mine = got[got.query_id == q].sort_values("rank")
        assert list(mine.vec_id) == want and list(mine.score) == list(s[want])


def test_shard_drops_rows():
    """With few strong terms most rows are never essential; results stay exact, negative scores too."""
    rng = np.random.default_rng(5)
    x = np.where(rng.random((500, 40)) < 0.1, rng.integers(-9, 60, (500, 40)), 0).astype(float)
    ids = rng.permutation(500)
    for sign in (1, -1):
        q = sign * np.where(rng.random(40) < 0.3, rng.integers(1, 50, 40), 0).astype(float)
        s = x @ q
        want = np.lexsort((ids, -s))[:10]
        near, score = Shard(ids, x).search(-5, q, 10, 4)
        assert list(ids[near]) == list(ids[want]) and list(score) == list(s[want])
    near, score = Shard(ids, -np.abs(x) - 1).search(-5, np.ones(40), 10, 4)
    assert len(near) == 10 and (score < 0).all()


def test_empty(spark):
    for search in (multiindex.search, maxscore.search):
        assert search(spark, spark.createDataFrame([], EMPTY), lambda i: i % 100 == 0).count() == 0
        few = search(spark, spark.createDataFrame([(0, [1.0, 2.0], "q"), (5, [2.0, 1.0], "q")], EMPTY), lambda i: i % 100 == 0).collect()
        assert [(r["query_id"], r["rank"], r["vec_id"]) for r in few] == [(0, 1, 5)]


def test_multiindex_repeated_query(spark):
    """A query row that comes three times has ten different neighbours, each listed once."""
    x = clusters(600)
    p = multiindex.Params(bin_rows=64)
    again = [(100, [float(v) for v in x[100]], "q")] * 2
    got = multiindex.search(spark, frame(spark, x, again), lambda i: i % 100 == 0, p=p).toPandas()
    s = np.sqrt(((x.astype(float) - x[100]) ** 2).sum(1))
    want = [i for i in np.lexsort((np.arange(600), s)) if i != 100][:10]
    assert list(got[got.query_id == 100].sort_values("rank").vec_id) == want


def test_maxscore_repeated_query_and_large_components(spark):
    """A query row that comes three times counts once; sums past 2^53 are exact, past 64 bits the nearest number."""
    x = clusters(300)
    big = {7: 1e4, 8: -1e4, 9: 3e6, 10: 1e10, 11: 1e305}
    rows = [(i, [float(v) * big.get(i, 1) for v in x[i].astype(float)], "q") for i in range(300)]
    rows += [(100, rows[100][1], "q")] * 2 + [(200, [v * 3e6 for v in rows[200][1]], "q")]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    p = maxscore.Params(least_rows=50, spread=5, block_rows=3)
    got = maxscore.search(spark, d, lambda i: i % 100 == 0, p=p).toPandas()
    whole = [(i, [int(np.nan_to_num(np.floor(v * 1024))) for v in r]) for i, r, _ in rows]
    for q in (0, 100, 200):
        asked = {tuple(r) for i, r in whole if i == q}
        found = [(-max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(r, v)))), i) for v in asked for i, r in whole if i != q]
        mine = got[got.query_id == q].sort_values("rank")
        assert [(-s, i) for s, i in zip(mine.score.tolist(), mine.vec_id)] == sorted(found)[:10]


def recall(spark, x, ids=None):
    """Share of the true ten nearest that the shipped parameters find, and the largest share of rows a walk passes."""
    ids = np.arange(len(x)) if ids is None else ids
    rows = spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in zip(ids, x)], "vec_id long, embedding array<float>")
    got = multiindex.search(spark, rows, lambda i: i % 100 == 0).toPandas()
    x, hit, n = x.astype(np.float32).astype(float), 0, 0
    for q in np.flatnonzero(ids % 100 == 0):
        s = ((x - x[q]) ** 2).sum(1)
        s[q] = np.inf
        hit += len(set(ids[np.argsort(s, kind="stable")[:10]]) & set(got[got.query_id == ids[q]].vec_id))
        n += 10
    return hit / n


def test_multiindex_recall_of_the_defaults(spark):
    """Params() on unit vectors of nearly uniform noise around ten centres, more of them than centroids."""
    rng = np.random.default_rng(2)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    x = unit(0.47 * unit(rng.normal(size=(10, 64)))[rng.integers(0, 10, 12_000)] + 0.88 * unit(rng.normal(size=(12_000, 64))))
    assert multiindex.Params().share <= 0.2 and recall(spark, x) >= 0.9


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="needs the test tables")
def test_multiindex_recall_on_the_tables(spark):
    rows = pq.read_table("/root/testdata/sf0.1/embeddings.parquet")
    assert recall(spark, np.stack(rows["embedding"].to_pylist()), rows["vec_id"].to_numpy()) >= 0.9


@pytest.mark.skipif(not os.path.isdir("/root/testdata/check_l"), reason="needs the test tables")
def test_multiindex_recall_outside_the_sample(spark):
    """Shipped parameters on a table of more rows than the sample: neighbours that no codebook was fitted on."""
    p, path = multiindex.Params(), "/root/testdata/check_l/embeddings.parquet"
    rows = spark.read.parquet(path).where("embedding IS NOT NULL AND size(filter(embedding, x -> x IS NULL OR isnan(x) OR abs(x) = double('inf'))) = 0 AND exists(embedding, x -> x <> 0)")
    seen = {r[0] for r in multiindex.fitted_rows(rows, rows.count(), p).select("vec_id").collect()}
    got = multiindex.search(spark, spark.read.parquet(path), lambda i: i % 100 == 0).toPandas().groupby("query_id")["vec_id"].apply(set)
    table = rows.toPandas()
    ids, x = table["vec_id"].to_numpy(), np.stack(table["embedding"]).astype(float)
    square, hit, n = (x * x).sum(1), [0, 0], [0, 0]
    for i in np.flatnonzero(ids % 100 == 0):
        s = square - 2 * x @ x[i]
        s[ids == ids[i]] = np.inf
        for j in np.argsort(s, kind="stable")[:10]:
            n[ids[j] in seen] += 1
            hit[ids[j] in seen] += ids[j] in got[ids[i]]
    assert n[0] > 1000 and hit[0] >= 0.9 * n[0] and sum(hit) >= 0.9 * sum(n), (hit, n)
    print("recall outside, inside the sample:", hit[0] / n[0], hit[1] / n[1])


def test_walk_against_sorting():
    rng = np.random.default_rng(6)
    for side in (1, 3, 64):
        for _ in range(40):
            near, far = rng.random(rng.integers(1, 9)), rng.random(rng.integers(1, 9)).round(1)
            counts = rng.integers(0, 4, (len(near), len(far)))
            if not counts.any():
                continue
            want = int(rng.integers(1, counts.sum() + 3))
            order = sorted((near[i] + far[j], i * len(far) + j) for i, j in zip(*np.nonzero(counts)))
            cells, held = [], 0
            for _, c in order:
                if held < want:
                    cells.append(c)
                    held += counts.ravel()[c]
            assert list(multiindex.walk(near, far, counts, want, side)) == cells


def test_multiindex_id_of_many_rows(spark):
    """A query whose id a third of all rows share still finds ten others; long vectors are taken whole."""
    x = clusters(900, 300)
    rows = [(0 if i % 3 == 0 else i, [float(v) for v in r], "q") for i, r in enumerate(x)]
    got = multiindex.search(spark, spark.createDataFrame(rows, EMPTY), lambda i: i == 0).toPandas()
    assert list(got["rank"]) == list(range(1, 11)) and 0 not in set(got.vec_id)
