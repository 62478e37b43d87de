"""Approximate nearest neighbours with an inverted multi-index.

Both halves of the vectors are quantised by their own k-means codebook; a cell of the index is a pair
of centroids. A query walks the cells by the sum of both distances, nearest first, with a heap over
the grid of sorted centroids (the multi-sequence walk), until the cells it passed hold its share of
candidates, and the entries are reranked by the exact distance.

The codebooks are fitted on a bounded sample (sample_rows, the first by a seeded hash) and every row
is indexed. Cells in order are cut into bins of about bin_rows rows, a cell of more rows into several,
so a hot cell spreads over many tasks; a task meets one bin with the queries that reach it, each with
the list of its own cells there. Only the codebooks and one count per cell (4 bytes for each pair of
centroids, 16 MiB at most) are on the driver and in the workers. Recall against brute force is tested.

How many rows a query meets follows from the data: where they have structure, the nearest cells hold
the neighbours; in uniform noise of d dimensions, quantised distances say less the larger d is, and
only finer codebooks and a larger share help. The defaults are those that noise of 64 dimensions needs.
Rows of the sample lie nearer to their centroids than others do and are found more often; where the
table is no larger than a codebook, every row is its own centroid and the walk's order is the exact one.
So recall has to be measured on rows outside the sample: their part grows with the table.

Behaviour: vectors that are null, empty, zero, of another length than the most common, or hold null
or non-finite components take no part, nor do rows without an id. A row repeated under one id is
listed once per row, except as its own neighbour: candidates of the query's own id are left out, and
a query meets as many rows more as have its id. A query row repeated with the same vector is searched
once. Different vectors under one query id are searched each, and the id's list holds the best of all:
a neighbour of several is listed for each. Ties go to the smaller id. An empty table gives an empty
table. Extra columns are ignored. Vectors of any length are taken whole.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratapack.llm.common import ragged, start
from stratapack.llm.vectors import best, clean, common_length, matrix, top
from stratapack.session import materialize


@dataclass(frozen=True)
class Params:
    k: int = 10
    #: Of each half; fewer only where the sample has fewer different vectors.
    centroids: int = 2048
    #: The share of all rows that a query's cells hold before its walk ends.
    share: float = 0.2
    bin_rows: int = 2048
    sample_rows: int = 20_000
    rounds: int = 6
    seed: int = 11


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Each row's nearest centroid, some rows at a time."""
    c, square = c.astype(np.float32), (c * c).sum(1).astype(np.float32)
    return np.concatenate([np.zeros(0, np.int64), *[(square - 2 * x[i : i + 1024].astype(np.float32) @ c.T).argmin(1) for i in range(0, len(x), 1024)]])


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Lloyd's rounds from k different rows of the sample; an empty cluster keeps its centroid."""
    different = np.unique(x, axis=0)
    c = different[np.random.default_rng(seed).permutation(len(different))[:k]]
    for _ in range(rounds):
        near = nearest(x, c)
        order = np.argsort(near, kind="stable")
        mine, begins = np.unique(near[order], return_index=True)
        c[mine] = np.add.reduceat(x[order], begins, axis=0) / np.bincount(near, minlength=len(c))[mine, None]
    return c


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of each row to each centroid."""
    return (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)


def walk(near: np.ndarray, far: np.ndarray, counts: np.ndarray, want: int, side: int = 64) -> np.ndarray:
    """Cells (numbered through counts) by summed distance until they hold `want` rows: the multi-sequence walk.

    The heap holds blocks of side x side pairs of sorted centroids by their least sum. Pairs of popped
    blocks are settled up to the least sum of the blocks still in the heap.
    """
    a, b = np.argsort(near, kind="stable"), np.argsort(far, kind="stable")
    first, second = near[a], far[b]
    heap, sums, cells, held = [(first[0] + second[0], 0, 0)], [], [], []
    rows = checked = 0
    while heap:
        _, i, j = heapq.heappop(heap)
        x, y = slice(i, i + side), slice(j, j + side)
        c = counts[np.ix_(a[x], b[y])]
        p, q = np.nonzero(c)
        sums.append(first[x][p] + second[y][q])
        cells.append(a[x][p] * len(far) + b[y][q])
        held.append(c[p, q])
        rows += int(held[-1].sum())
        if j + side < len(far):
            heapq.heappush(heap, (first[i] + second[j + side], i, j + side))
        if j == 0 and i + side < len(near):
            heapq.heappush(heap, (first[i + side] + second[0], i + side, 0))
        if rows >= want and rows >= checked or not heap:
            s, h = np.concatenate(sums), np.concatenate(held)
            if not heap or h[s < heap[0][0]].sum() >= want:
                break
            checked = rows + want // 8
    s, cell, h = np.concatenate(sums), np.concatenate(cells), np.concatenate(held)
    order = np.lexsort((cell, s))
    return cell[order[: int(np.searchsorted(np.cumsum(h[order]), want)) + 1]]


def fitted_rows(vectors: DataFrame, n: int, p: Params) -> DataFrame:
    """The bounded sample of n vectors that the codebooks are fitted on."""
    key = F.xxhash64("vec_id", F.lit(p.seed))
    share = min(1.0, 1.1 * p.sample_rows / n)
    return vectors.where(F.pmod(key, F.lit(1 << 20)) < int(share * (1 << 20)) + 1).orderBy(key, "vec_id").limit(p.sample_rows)


def search(spark: SparkSession, rows: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", p: Params = Params()) -> DataFrame:
    """The p.k nearest found of each query row: query_id, rank, vec_id, score (Euclidean distance)."""
    start(spark)
    vectors = clean(rows, id_col, vector_col, nonzero=True)
    d, n = common_length(vectors)
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    vectors = vectors.where(F.size("vector") == d)
    half = max(d // 2, 1)
    key = F.xxhash64("vec_id", F.lit(p.seed))
    sample = fitted_rows(vectors, n, p).select("vector").toPandas()
    x = matrix(sample["vector"], d)
    one = kmeans(x[:, :half], p.centroids, p.rounds, p.seed)
    two = kmeans(x[:, half:], p.centroids, p.rounds, p.seed + 1) if d > 1 else np.zeros((1, 0))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            v = matrix(b["vector"], d)
            yield b.assign(cell=(nearest(v[:, :half], one) * len(two) + nearest(v[:, half:], two)).astype(np.int32))

    indexed = materialize(spark, vectors.withColumn("key", F.pmod(key, F.lit(1 << 30))).mapInPandas(assign, "vec_id long, vector array<double>, key long, cell int"), "index")
    counts = np.zeros(len(one) * len(two), np.int32 if n < 1 << 31 else np.int64)
    for r in indexed.groupBy("cell").count().toLocalIterator():  # one row per cell at most
        counts[r["cell"]] = r["count"]
    shared, size, k = spark.sparkContext.broadcast((one, two, counts.reshape(len(one), len(two)))), p.bin_rows, p.k

    def bins(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each cell's first bin, and how many bins it is spread over."""
        flat = counts.ravel()
        return (np.cumsum(flat, dtype=np.int64) - flat) // size, np.maximum(1, -(-flat // size))

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one, two, counts = shared.value
        first, spread = bins(counts)
        for b in batches:
            v, out = matrix(b["vector"], d), []
            for i in range(len(b)):
                near, far = distances(v[i : i + 1, :half], one)[0], distances(v[i : i + 1, half:], two)[0]
                mine = walk(near, far, counts, max(int(np.ceil(p.share * n)), 4 * k) + int(b["own"].iloc[i]))
                to, of = first[mine], spread[mine]
                cells, to = np.repeat(mine, of), ragged(to, of)
                order = np.lexsort((cells, to))
                cells, to = cells[order].astype(np.int32), to[order]
                reached, at = np.unique(to, return_index=True)
                out += [(b["vec_id"].iloc[i], b["vector"].iloc[i], c.tobytes(), r) for c, r in zip(np.split(cells, at[1:]), reached, strict=True)]
                if len(out) >= 1000:
                    yield pd.DataFrame(out, columns=["query_id", "vector", "cells", "bin"])
                    out = []
            yield pd.DataFrame(out, columns=["query_id", "vector", "cells", "bin"])

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, spread = bins(shared.value[2])
        for b in batches:
            c = b["cell"].to_numpy()
            yield pd.DataFrame({"vec_id": b["vec_id"], "vector": b["vector"], "cell": c, "bin": first[c] + b["key"].to_numpy() % spread[c]})

    entries = indexed.mapInPandas(place, "vec_id long, vector array<double>, cell int, bin long")
    asked = vectors.where(is_query(F.col("vec_id")))
    asked = asked.dropDuplicates(["vec_id", "vector"]).join(asked.groupBy("vec_id").agg(F.count(F.lit(1)).alias("own")), "vec_id")
    queries = asked.mapInPandas(probe, "query_id long, vector array<double>, cells binary, bin long")

    def rerank(e: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        ids, cells, x, out = e["vec_id"].to_numpy(), e["cell"].to_numpy(), matrix(e["vector"], d), []
        for qid, v, marks in zip(q["query_id"], q["vector"], q["cells"], strict=True) if len(e) else ():
            at = np.flatnonzero(np.isin(cells, np.frombuffer(marks, np.int32)) & (ids != qid))
            s = np.sqrt(((x[at] - np.asarray(v)) ** 2).sum(1))
            near = best(ids[at], s, k)
            out.append(pd.DataFrame({"query_id": qid, "vec_id": ids[at[near]], "score": s[near]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})

    met = entries.groupBy("bin").cogroup(queries.groupBy("bin")).applyInPandas(rerank, "query_id long, vec_id long, score double")
    return top(met, k, F.col("score"))
