"""Exact top-k by inner product of integer vectors, with MaxScore.

Each dimension is a term and its value a signed impact; a shard holds, per term and sign of the
query's weight, the postings whose contribution is positive, and the term's largest contribution is
its score bound. For one query the terms are ordered by bound. The non-essential ones are the longest
tail whose bounds add up to less than the current k-th score: a row that is in no essential posting
can't reach it. Rows of essential postings are scored on the essential terms, then the other terms
are probed in falling order of bound, and a row is dropped once its score plus the bounds still to
come stays under the k-th. The first k-th score comes from the rows with the largest contributions to
the query's strongest terms. Everything is integer arithmetic in doubles where a query's bound for its
shard is below 2^53, so that no sum can round. Beyond that no row is dropped early, and rows whose own
bound is that large are scored in whole numbers of any size. A score beyond 64 bits counts as the
nearest 64-bit number, in ranks as well.

Rows are dealt to shards and queries to blocks by hash; a task scores one shard with one block, both
of bounded size, and every pair of them meets once. The shards' best are merged per query.

Behaviour: vectors that are null, empty, of another length than the most common, or hold null or
non-finite components take no part, nor do rows without an id; zero vectors do. Candidates of the
query's own id are left out; a row repeated under one id is listed once per row. A query row repeated
with the same vector is searched once; different vectors under one query id are searched each, and the
id's list holds the best of all. Ties go to the smaller id. An empty table gives an empty table. Extra
columns are ignored. Vectors of any length are taken whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratapack.llm.common import start
from stratapack.llm.vectors import best, clean, common_length, matrix, top


@dataclass(frozen=True)
class Params:
    k: int = 10
    scale: float = 1024.0
    #: Rows of a shard, queries of a block: the bounds of one task.
    shard_rows: int = 16_384
    block_rows: int = 4096
    #: Below shard_rows, shards shrink down to this to keep up to `spread` tasks busy.
    least_rows: int = 512
    spread: int = 64
    #: Terms probed together.
    step: int = 8


class Shard:
    """Postings of one shard: per dimension the rows by value, both ways from the ends."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        self.order = np.argsort(x, axis=0, kind="stable").T.copy()  # per term its rows by rising impact
        self.low, self.high = x.min(0), x.max(0)
        self.negative, self.positive = (x < 0).sum(0), (x > 0).sum(0)

    def posting(self, term: int, weight: float) -> np.ndarray:
        """Rows to which the term adds, the largest contribution first."""
        n = len(self.ids)
        if weight > 0:
            return self.order[term][n - self.positive[term] :][::-1]
        return self.order[term][: self.negative[term]]

    def search(self, qid: int, q: np.ndarray, k: int, step: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best rows and their scores."""
        with np.errstate(over="ignore"):
            bound = np.abs(q) * np.maximum(np.abs(self.low), np.abs(self.high))
        if bound.sum() >= EXACT:
            return self.search_large(qid, q, k)
        n = len(self.ids)
        bound = np.maximum(np.maximum(q * self.low, q * self.high), 0)
        terms = np.argsort(-bound, kind="stable")
        rest = np.concatenate([np.cumsum(bound[terms][::-1])[::-1], [0]])  # what the terms from i on can add
        seeds = np.unique(np.concatenate([self.posting(t, q[t])[: 2 * k] for t in terms[:step]]))
        seeds = seeds[self.ids[seeds] != qid]
        floor = -np.inf
        if len(seeds) >= k:
            floor = np.partition(self.x[seeds] @ q, len(seeds) - k)[len(seeds) - k]
        # Essential are the terms before the longest tail that stays under the k-th score. Where the
        # score can be reached without any positive contribution, every row is a candidate.
        essential = int(np.searchsorted(-rest, -floor, side="right")) if floor > 0 else len(terms) + 1
        if essential > len(terms):
            rows, essential = np.arange(n), min(step, len(terms))
        else:
            hit = np.zeros(n, bool)
            for t in terms[:essential]:
                hit[self.posting(t, q[t])] = True
                if hit.all():
                    break
            rows = np.flatnonzero(hit)
        rows = rows[self.ids[rows] != qid]
        # On the essential terms, a few at a time, then the others: what can't compete is dropped.
        score, at = np.zeros(len(rows)), 0
        while at < len(terms) and len(rows):
            some = terms[at : at + step]
            score = score + self.x[np.ix_(rows, some)] @ q[some]
            at += len(some)
            alive = score + rest[at] >= floor
            if not alive.all():
                rows, score = rows[alive], score[alive]
        near = best(self.ids[rows], -score, k)
        return rows[near], score[near].astype(np.int64)

    def search_large(self, qid: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The same where sums may not fit a double: every row is scored, large ones in whole numbers."""
        rows = np.flatnonzero(self.ids != qid)
        with np.errstate(over="ignore"):
            large = np.abs(self.x[rows]) @ np.abs(q) >= EXACT
        score = np.zeros(len(rows), np.int64)
        score[~large] = self.x[rows[~large]] @ q
        whole = [int(v) for v in q]
        score[large] = [max(-MOST - 1, min(MOST, sum(int(a) * b for a, b in zip(self.x[r], whole, strict=True)))) for r in rows[large]]
        near = np.lexsort((self.ids[rows], ~score))[:k]  # ~score falls as score rises, without overflow
        return rows[near], score[near]


#: Half of 2^53: sums of whole numbers below it are exact in doubles, and rounding can't hide one that isn't.
EXACT = float(1 << 52)
MOST = (1 << 63) - 1


def quantised(column: pd.Series, d: int, scale: float) -> np.ndarray:
    """Whole numbers as doubles, finite even where a component times scale is not."""
    with np.errstate(over="ignore"):
        return np.nan_to_num(np.floor(matrix(column, d) * scale))


def search(spark: SparkSession, rows: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", p: Params = Params()) -> DataFrame:
    """The p.k highest scores of each query row: query_id, rank, vec_id, score (integer inner product)."""
    start(spark)
    vectors = clean(rows, id_col, vector_col, nonzero=False)
    d, n = common_length(vectors)
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    vectors = vectors.where(F.size("vector") == d)
    asked = vectors.where(is_query(F.col("vec_id"))).dropDuplicates(["vec_id", "vector"])
    shards = max(-(-n // p.shard_rows), min(p.spread, -(-n // p.least_rows)))
    blocks = max(1, -(-asked.count() // p.block_rows))
    scale, k, step = p.scale, p.k, p.step
    deal = lambda of, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(of))
    pairs = lambda shard, block: F.explode(F.transform(F.sequence(F.lit(0), F.lit((blocks if shard is not None else shards) - 1)), lambda i: shard * blocks + i if shard is not None else i * blocks + block))
    held = vectors.withColumn("task", pairs(deal(shards, 1), None))
    asked = asked.withColumn("task", pairs(None, deal(blocks, 2)))

    def score(e: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(e) and len(q):
            shard = Shard(e["vec_id"].to_numpy(), quantised(e["vector"], d, scale))
            for qid, v in zip(q["vec_id"], quantised(q["vector"], d, scale), strict=True):
                near, s = shard.search(qid, v, k, step)
                out.append(pd.DataFrame({"query_id": qid, "vec_id": shard.ids[near], "score": s.astype(np.int64)}))
        return pd.concat(out) if out else pd.DataFrame({c: np.zeros(0, np.int64) for c in ("query_id", "vec_id", "score")})

    met = held.groupBy("task").cogroup(asked.groupBy("task")).applyInPandas(score, "query_id long, vec_id long, score long")
    return top(met, k, F.col("score").desc())
