"""Quality classifier: supervised subword embeddings.

Every word between white space, its character n-grams (with its boundaries), and each pair of
neighbouring words are hashed to rows of an embedding table. Pairs have two rows: that of the very
pair, and that of the pair of their classes, where words fall into `classes` classes by hash, so that a
pair never met in training still has a learnt row. A document is the average of its rows, a softmax
layer gives the class, and numpy stochastic gradient descent learns both; no feature is made to mark
either class. As the layer after the average is linear, scoring folds table and layer into one number
per hash row, so a document's logit is a mean over its features, taken over the whole text.

Fitting uses a bounded sample of the labelled rows (max_train_docs documents of at most
max_doc_bytes each, the first by a seeded hash of doc_id), never the held-out quarter. The rest of
the work covers every row.

Behaviour: a null or empty text has no features and scores the softmax of the bias alone; a very long
text is scored whole, by one worker; a label that is null is left out; a document labelled more than
once takes its lowest label; repeated rows repeat their score; with no labels at all (or labels of one
class only) the score is that class's share, 0.5 without any; an empty table gives an empty table.
Extra columns are ignored by score_documents() and kept by keep_good().
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratapack.llm.common import ascii_words, mix64, row_bounds, slices, start, strings, text_or_empty

THRESHOLD = 0.7
#: Bytes of text scored at once: the features of its distinct words take some thirty times as much.
SLICE = 2 << 20


@dataclass(frozen=True)
class Params:
    buckets: int = 1 << 17
    classes: int = 32
    dim: int = 8
    grams: tuple[int, ...] = (3,)
    epochs: int = 4
    #: Few documents are gone over more often, up to this many steps.
    least_steps: int = 6000
    rate: float = 0.5
    seed: int = 7
    max_train_docs: int = 3000
    max_doc_bytes: int = 32_768


GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def code_points(words: pa.Array) -> np.ndarray:
    """The words' characters, one after the other."""
    data = pa.concat_arrays([words]).buffers()[2]
    size = int(pc.sum(pc.binary_length(words)).as_py() or 0)
    return np.frombuffer(data[:size].to_pybytes().decode().encode("utf-32-le"), np.uint32) if size else np.zeros(0, np.uint32)


def word_features(words: pa.Array, p: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash rows of each distinct word's own features, the word each belongs to, and the words' whole hashes."""
    lens = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    n, points = len(lens), code_points(words).astype(np.uint64)
    starts = np.concatenate([[0], np.cumsum(lens)])[:-1]
    owner = np.repeat(np.arange(n), lens)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(int(lens.max(initial=0)) + 1, 1099511628211, np.uint64))
        whole = np.add.reduceat((points + np.uint64(1)) * power[np.arange(len(points)) - starts[owner]], starts) if n else np.zeros(0, np.uint64)
        whole = mix64(whole)
        rows, owners = [whole], [np.arange(n)]
        # Words side by side, 0 between them and at both ends; a gram may touch a 0 at its ends only.
        padded = np.zeros(len(points) + n + 1, np.uint64)
        padded[np.arange(len(points)) + owner + 1] = points
        edge = padded == 0
        of = np.cumsum(edge) - 1  # the word at a place, of a 0 the next word
        for k in p.grams:
            m = len(padded) - k + 1
            if m <= 0:
                continue
            h = np.full(m, k, np.uint64)
            inner = np.ones(m, bool)
            for j in range(k):
                h = h * np.uint64(1000003) + padded[j : j + m]
                if 0 < j < k - 1:
                    inner &= ~edge[j : j + m]
            at = np.flatnonzero(inner & ~(edge[:m] & edge[1 : m + 1]))
            rows.append(mix64(h[at]))
            owners.append(of[at])
    return _rows(np.concatenate(rows), p), np.concatenate(owners), whole


def _rows(hashes: np.ndarray, p: Params) -> np.ndarray:
    """Rows of the table behind those of the class pairs."""
    return (hashes % np.uint64(p.buckets) + np.uint64(p.classes**2)).astype(np.int64)


def pair_features(rows: np.ndarray, hashes: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """(2, pairs) hash rows of each pair of neighbouring words of a text, and the place of each pair's second word."""
    at = np.flatnonzero(rows[1:] == rows[:-1]) + 1
    with np.errstate(over="ignore"):
        whole = mix64(hashes[at - 1] * GOLDEN + hashes[at])
    classes = (hashes >> np.uint64(40)) % np.uint64(p.classes)
    return np.stack([_rows(whole, p), (classes[at - 1] * np.uint64(p.classes) + classes[at]).astype(np.int64)]), at


@dataclass(frozen=True)
class Model:
    """One weight per hash row and a bias: the logit of label 1 against label 0."""

    params: Params
    weights: np.ndarray
    bias: float

    def score(self, texts: pa.Array) -> np.ndarray:
        n = len(texts)
        rows, words, index = ascii_words(texts)
        own, owner, hashes = word_features(words, self.params)
        sums = np.bincount(owner, weights=self.weights[own], minlength=len(words)).astype(float)[index]
        counts = np.bincount(owner, minlength=len(words))[index]
        pairs, at = pair_features(rows, hashes[index], self.params)
        sums[at] += self.weights[pairs].sum(0)
        counts[at] += 2
        ends = row_bounds(rows, n)
        total, size = np.diff(np.concatenate([[0.0], np.cumsum(sums)])[ends]), np.diff(np.concatenate([[0], np.cumsum(counts)])[ends])
        return 1 / (1 + np.exp(-np.clip(total / np.maximum(size, 1) + self.bias, -60, 60)))


def document_features(texts: list[str], p: Params) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each text's hash rows and their shares of its features."""
    out = []
    for i in range(0, len(texts), 256):
        part = pa.array(texts[i : i + 256], pa.string())
        rows, words, index = ascii_words(part)
        own, owner, hashes = word_features(words, p)
        order = np.argsort(owner, kind="stable")
        own, at = own[order], np.searchsorted(owner[order], np.arange(len(words) + 1))
        pairs, second = pair_features(rows, hashes[index], p)
        ends = row_bounds(rows, len(part))
        for d in range(len(part)):
            kinds, times = np.unique(index[ends[d] : ends[d + 1]], return_counts=True)
            mine = pairs[:, np.searchsorted(second, ends[d]) : np.searchsorted(second, ends[d + 1])].ravel()
            ids = np.concatenate([*[own[at[k] : at[k + 1]] for k in kinds], mine])
            w = np.concatenate([np.repeat(times, at[kinds + 1] - at[kinds]), np.ones(len(mine))])
            ids, back = np.unique(ids.astype(np.int64), return_inverse=True)
            w = np.bincount(back, weights=w, minlength=len(ids))
            out.append((ids.astype(np.int32), (w / max(w.sum(), 1)).astype(np.float32)))
    return out


def fit(texts: list[str], labels: list[int], p: Params = Params()) -> Model:
    """Stochastic gradient descent over averaged feature vectors and a two-class softmax."""
    y = np.array(labels, np.int64)
    share = float(y.mean()) if len(y) else 0.5
    size = p.buckets + p.classes**2
    if len(set(labels)) < 2:
        share = min(max(share, 1e-3), 1 - 1e-3)
        return Model(p, np.zeros(size), float(np.log(share / (1 - share))) if len(y) else 0.0)
    feats = document_features(texts, p)
    rng = np.random.default_rng(p.seed)
    table = rng.uniform(-1 / p.dim, 1 / p.dim, (size, p.dim)).astype(np.float32)
    layer = np.zeros((p.dim, 2), np.float32)
    bias = np.zeros(2, np.float32)
    epochs = max(p.epochs, -(-p.least_steps // len(y)))
    step, steps = 0, epochs * len(y)
    # Each class weighs the same in sum, so the rarer one is learnt as well; scores are as of an even prior.
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
    for _ in range(epochs):
        for d in rng.permutation(len(y)):
            rate = p.rate * (1 - step / steps)
            step += 1
            ids, w = feats[d]
            v = w @ table[ids]
            z = v @ layer + bias
            e = np.exp(z - z.max())
            g = e / e.sum()
            g[y[d]] -= 1
            g *= weight[d] * rate
            back = layer @ g
            layer -= np.outer(v, g)
            bias -= g * 0.1
            # Rows move by their share; scaled up so that frequent and rare features learn alike.
            table[ids] -= np.outer(np.sqrt(w), back)
    weights = table.astype(float) @ (layer[:, 1] - layer[:, 0]).astype(float)
    return Model(p, weights, float(bias[1] - bias[0]))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> Model:
    """Fit on the bounded sample; only its rows come to the driver."""
    marked = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("label"))
    key = F.xxhash64("doc_id", F.lit(p.seed))
    n = marked.count()
    if not n:
        return fit([], [], p)
    # A share of the hash's range that holds a tenth more than the sample, then the exact bound.
    share = min(1.0, 1.1 * p.max_train_docs / n)
    some = marked.where(F.pmod(key, F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    sample = docs.where(F.octet_length("text") <= p.max_doc_bytes).select("doc_id", "text").join(F.broadcast(some), "doc_id")
    rows = sample.orderBy(key, "text").limit(p.max_train_docs).select("text", "label").collect()
    return fit([r[0] for r in rows], [int(r[1]) for r in rows], p)


def score_documents(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; one map, the model travels as a broadcast of fixed size."""
    start(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in slices(batches, "text", SLICE):
            score = m.score(strings(b.column("text")))
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "held_out": b.column("held_out"), "score": pa.array(score), "predicted": pa.array((score >= THRESHOLD).astype(np.int32))})

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), text_or_empty().alias("text"))
    return d.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """The rows that the classifier accepts, with all their columns."""
    start(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in slices(batches, "text", SLICE):
            yield b.filter(pa.array(m.score(strings(b.column("text"))) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
