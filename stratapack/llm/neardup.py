"""Near-duplicate groups with SuperMinHash.

SuperMinHash (Ertl 2017) gives each set element one rank in every signature slot, from a permutation
of the slots, so the slots' values are correlated and the estimate's variance falls below MinHash's.
Its stop: step j only yields values of at least j, so once every slot holds less, the rest is
skipped. Values are integers (step << 32 | random part).

1. Signatures: one map over the texts to a small table of band keys.
2. Equal sets collapse: documents with the same set are one node, its smallest doc_id.
3. Banding: each node meets its bucket's smallest node (a star, never all pairs). The star a node
   shares most bands with is verified on both full sets.
4. Union-find by pointer jumping over the verified links.
5. Buckets that still hold several components: every node outside its cluster's largest component
   meets all nodes of the cluster in blocks of bounded size, on full sets, and only links come out.
   After this no two candidates of different components are untested.
6. Label propagation over the components' links and those between the sets of a doc_id that has
   several, a star around its smallest component.

At threshold 0.8 a linked pair is missed by all 32 bands of 4 with probability 5e-8.
Nothing is collected on the driver; stages are cut by tables in the shared folder.

Behaviour: a document without words (or null) has an empty set and stays alone. Rows that share a
doc_id count as one document with the links of all its texts, those without words included; all of
a kept document's rows are kept. A row without doc_id takes part in nothing: null component, kept. An empty table gives an
empty table. Extra columns are ignored by groups().
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratapack.llm.common import mix64, ragged, slices, start, strings, text_or_empty
from stratapack.llm.shingles import shingle_sets
from stratapack.session import materialize

SLOTS = 128
BANDS = 32


@dataclass(frozen=True)
class Params:
    words: int = 5
    percent: int = 80  # links: 100 * intersection >= percent * union
    #: Nodes of one block, as targets and as queries.
    targets: int = 512
    queries: int = 1024


GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def signature(x: np.ndarray, m: int = SLOTS) -> np.ndarray:
    """The SuperMinHash of a set of 64-bit hashes."""
    n = len(x)
    h = np.full(m, np.iinfo(np.uint64).max, np.uint64)
    ranks, rows = None, np.arange(n)
    with np.errstate(over="ignore"):
        for j in range(m):
            z = mix64(x + GOLDEN * np.uint64(j + 1))
            k = j + ((z & np.uint64(0xFFFFFFFF)) % np.uint64(m - j)).astype(np.int64)
            if j == 0:
                slot, first = k, k
            else:
                if ranks is None:  # Fisher-Yates, one row of slots per element; the first swap is made up for
                    ranks = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), (n, 1))
                    ranks[rows, first] = 0
                slot = ranks[rows, k].astype(np.int64)
                ranks[rows, k] = ranks[:, j]
            np.minimum.at(h, slot, np.uint64(j << 32) | (z >> np.uint64(32)))
            if h.max() < np.uint64((j + 1) << 32):
                break
    return h


def bands(h: np.ndarray, b: int = BANDS) -> np.ndarray:
    with np.errstate(over="ignore"):
        rows = h.reshape(b, -1)
        key = np.arange(1, b + 1, dtype=np.uint64)
        for c in range(rows.shape[1]):
            key = mix64(key * GOLDEN + rows[:, c])
    return key.view(np.int64)


def signatures(docs: DataFrame, p: Params) -> DataFrame:
    words = p.words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, np.ndarray] = {}
        for b in slices(batches, "text", 4 << 20):
            found = shingle_sets(strings(b.column("text")), words)
            digest = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None for x in found]
            keys = []
            for x, d in zip(found, digest, strict=True):
                if d is not None and d not in known:
                    if len(known) > 20_000:
                        known.clear()
                    known[d] = bands(signature(x))
                keys.append(None if d is None else known[d])
            yield pa.RecordBatch.from_pydict({
                "doc_id": b.column("doc_id"), "n": pa.array([len(x) for x in found], pa.int64()),
                "digest": pa.array([d and d.hex() for d in digest], pa.string()), "bands": pa.array(keys, pa.list_(pa.int64())),
            })

    return docs.mapInArrow(run, "doc_id long, n long, digest string, bands array<long>")


def verify(texts: DataFrame, pairs: DataFrame, p: Params) -> DataFrame:
    """The pairs (a, b) of documents that are linked, on full sets."""
    words, percent = p.words, p.percent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "ta", 2 << 20):
            left = shingle_sets(strings(b.column("ta")), words)
            coded = b.column("tb").dictionary_encode()  # a star's centre comes once per run of its rows
            right = shingle_sets(strings(coded.dictionary), words)
            keep = []
            for x, c in zip(left, coded.indices.to_pylist(), strict=True):
                y = right[c]
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")
    two = one.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
    return two.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def settle(spark: SparkSession, parents: DataFrame) -> DataFrame:
    """Pointer jumping over (id, parent), one parent each and parent < id: every id's root."""
    while True:
        up = parents.select(F.col("id").alias("parent"), F.col("parent").alias("next"))
        parents = materialize(spark, parents.join(up, "parent", "left").select("id", F.coalesce("next", "parent").alias("parent"), F.col("next").isNotNull().alias("moved")), "roots")
        if not parents.where("moved").limit(1).count():
            return parents.drop("moved")
        parents = parents.drop("moved")


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(id, label) of every end of the links (a, b): the smallest id of its component."""
    edges = materialize(spark, links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a")).distinct(), "edges")
    labels = materialize(spark, edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("id"), F.least("u", "m").alias("label")), "labels")
    while True:
        near = edges.join(labels.select(F.col("id").alias("v"), "label"), "v").groupBy(F.col("u").alias("id")).agg(F.min("label").alias("near"))
        met = labels.join(near, "id").select("id", "label", F.least("label", "near").alias("new"))
        jump = labels.select(F.col("id").alias("new"), F.col("label").alias("jumped"))
        new = materialize(spark, met.join(jump, "new", "left").select("id", F.least("new", F.coalesce("jumped", "new")).alias("new"), "label"), "labels")
        changed = new.where("new < label").limit(1).count()
        labels = new.select("id", F.col("new").alias("label"))
        if not changed:
            return labels


def links_in_block(targets: list[np.ndarray], queries: list[np.ndarray], percent: int) -> Iterator[np.ndarray]:
    """Per query the targets it is linked with: exact intersection sizes with all of them by one inverted list."""
    sizes = np.array([len(t) for t in targets])
    flat, owner = np.concatenate(targets), np.repeat(np.arange(len(targets)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    for q in queries:
        lo, hi = np.searchsorted(flat, q, "left"), np.searchsorted(flat, q, "right")
        both = np.bincount(owner[ragged(lo, hi - lo)], minlength=len(targets))
        yield np.flatnonzero((both > 0) & (100 * both >= percent * (sizes + len(q) - both)))


def block_links(spark: SparkSession, texts: DataFrame, here: DataFrame, p: Params) -> DataFrame:
    """Links (a, b) between components that meet in a bucket.

    Buckets that share nodes make a cluster. Every node outside its cluster's largest component is a
    query against all of the cluster, in blocks of bounded size; small clusters share blocks. Only links
    leave a block, no pairs.
    """
    # Each node joins its smallest bucket leader; what is left to connect are leaders that share a node.
    met = here.select("id", "comp", "lead").distinct().withColumn("first", F.min("lead").over(Window.partitionBy("id")))
    met = materialize(spark, met, "met")
    leaders = components(spark, met.where("lead <> first").select(F.col("lead").alias("a"), F.col("first").alias("b")).distinct())
    nodes = met.select("id", "comp", "first").distinct().join(leaders.withColumnRenamed("id", "first"), "first", "left")
    nodes = nodes.select("id", "comp", F.coalesce("label", "first").alias("cluster"))
    nodes = materialize(spark, nodes, "nodes")
    sizes = nodes.groupBy("cluster", "comp").agg(F.count(F.lit(1)).alias("c"))
    sizes = sizes.groupBy("cluster").agg(F.sum("c").alias("size"), F.max_by("comp", F.struct("c", -F.col("comp"))).alias("main"), F.max("c").alias("most"))
    sizes = materialize(spark, sizes, "clusters")
    small = F.col("size") <= p.targets
    shared = sizes.where(small).agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    bins = max(1, -(-shared // p.targets))
    nodes = nodes.join(sizes, "cluster").withColumn("asks", F.col("comp") != F.col("main"))
    across, down = F.ceil(F.col("size") / p.targets).cast("int"), F.ceil((F.col("size") - F.col("most")) / p.queries).cast("int")
    deal = lambda of, seed: F.pmod(F.xxhash64("id", F.lit(seed)), of).cast("int")
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    cell = lambda t, q, ask: F.struct(F.concat_ws(":", F.col("cluster"), t, q).alias("block"), F.lit(ask).alias("ask"))
    as_target = F.transform(upto(down), lambda q: cell(deal(across, 1), q, False))
    as_query = F.when(F.col("asks"), F.transform(upto(across), lambda t: cell(t, deal(down, 2), True))).otherwise(F.array().cast("array<struct<block:string,ask:boolean>>"))
    alone = F.array(F.struct(F.concat(F.lit("s"), F.pmod(F.xxhash64("cluster"), F.lit(bins)).cast("string")).alias("block"), F.lit(False).alias("ask")))
    cells = F.when(small, alone).otherwise(F.concat(as_target, as_query))
    placed = nodes.select("id", "comp", "asks", cells.alias("cells")).join(texts.withColumnRenamed("doc_id", "id"), "id").select("comp", "asks", "text", F.explode("cells").alias("cell")).select("comp", "asks", "text", "cell.*")
    words, percent = p.words, p.percent

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        comp = pdf["comp"].to_numpy()
        sets = shingle_sets(pa.array(pdf["text"], pa.string()), words)
        own = key[0].startswith("s")  # queries of small clusters are targets as well
        asks = np.flatnonzero(pdf["asks"] if own else pdf["ask"])
        targets = np.arange(len(pdf)) if own else np.flatnonzero(~pdf["ask"])
        out = set()
        if len(targets) and len(asks):
            for q, near in zip(asks, links_in_block([sets[t] for t in targets], [sets[q] for q in asks], percent), strict=True):
                out |= {(max(comp[q], c), min(comp[q], c)) for c in np.unique(comp[targets[near]]) if c != comp[q]}
        return pd.DataFrame(sorted(out), columns=["a", "b"], dtype=np.int64)

    return placed.groupBy("block").applyInPandas(run, "a long, b long").distinct()


def several_sets(table: DataFrame) -> DataFrame:
    """doc_id, one, last: the documents whose rows don't all have the same set, with the first and last of their digests."""
    all_of = table.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("digest").alias("one"), F.max("digest").alias("last"), F.max(F.col("digest").isNull()).alias("blank"))
    return all_of.where("one < last OR (blank AND one IS NOT NULL)").select("doc_id", "one", "last")


def document_links(table: DataFrame, several: DataFrame, sets: DataFrame, roots: DataFrame) -> DataFrame:
    """Links (a, b) between the components of each document's sets."""
    own = table.where("digest IS NOT NULL").join(several.where("one < last").select("doc_id"), "doc_id").select("doc_id", "digest").distinct()
    own = own.join(sets, "digest").join(roots, "id", "left").select("doc_id", F.coalesce("parent", "id").alias("a"))
    first = own.groupBy("doc_id").agg(F.min("a").alias("b"))
    return own.join(first, "doc_id").where("a <> b").select("a", "b").distinct()


def groups(spark: SparkSession, docs: DataFrame, p: Params = Params()) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept."""
    start(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    table = materialize(spark, signatures(texts, p), "signatures")
    sets = materialize(spark, table.where("n > 0 AND doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("id")), "sets")
    nodes = table.join(sets, "digest").where("doc_id = id").select("id", F.explode("bands").alias("key"))
    stars = materialize(spark, nodes.groupBy("key").agg(F.min("id").alias("lead"), F.max("id").alias("last")).where("lead < last").select("key", "lead"), "stars")
    buckets = materialize(spark, nodes.join(stars, "key"), "buckets")

    shared = buckets.where("id <> lead").groupBy("id", "lead").agg(F.count(F.lit(1)).alias("c"))
    tried = materialize(spark, shared.groupBy("id").agg(F.max_by("lead", F.struct("c", -F.col("lead"))).alias("lead")).select(F.col("id").alias("a"), F.col("lead").alias("b")), "tried")
    roots = settle(spark, materialize(spark, verify(texts, tried, p).distinct().groupBy(F.col("a").alias("id")).agg(F.min("b").alias("parent")), "links"))

    placed = materialize(spark, buckets.select("key", "id").join(roots, "id", "left").select("key", "id", F.coalesce("parent", "id").alias("comp")), "placed")
    mixed = materialize(spark, placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("id").alias("lead")).where("lo < hi").select("key", "lead"), "mixed")
    here = materialize(spark, placed.join(mixed, "key"), "here")
    several = materialize(spark, several_sets(table), "several")
    merged = components(spark, block_links(spark, texts, here, p).union(document_links(table, several, sets, roots)))

    labels = sets.join(roots, "id", "left").withColumn("comp", F.coalesce("parent", "id"))
    labels = labels.join(merged.select(F.col("id").alias("comp"), "label"), "comp", "left").select("digest", F.coalesce("label", "comp").alias("component_id"))
    labels = materialize(spark, labels, "components")
    table = table.select("doc_id", "n", "digest").join(several.select("doc_id", "one"), "doc_id", "left")
    out = table.select("doc_id", "n", F.coalesce("digest", "one").alias("digest")).join(labels, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def keep_first(spark: SparkSession, docs: DataFrame, p: Params = Params()) -> DataFrame:
    """The rows of one document per group, its smallest doc_id, with all their columns."""
    dropped = groups(spark, docs, p).where("NOT kept").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)
