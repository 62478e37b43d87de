"""Mixing sources to target weights by capped water-filling, in DataFrame functions only.

A document's size is its number of words. Sources, by code point with null last, weigh 1, 2, 3,
repeating. Each gets the share level * weight of all words, clamped at `cap` times its own size; the
level is the one at which the targets add up to the whole, found in closed form: with sources sorted
by (cap * size) / weight, the first k are clamped where the level of the rest stays below the next.

Whole repetitions are floor(target / size) of every document. The fractional rest takes documents in
a seeded random order for as long as the running sum of sizes stays at or under the rest, measured
to each document's middle, so a source misses its target by half a document at most. The running sum
is made in two levels, within hash buckets of bounded length and over the buckets' totals, so a
source with a third of all rows spreads over many tasks and only ids and sizes are shuffled. apply()
finds each source's last place in that order and compares rows with it where they lie.

Behaviour: null and empty texts have size 0 and are taken 0 words (0 times in apply()); a null source
is a source of its own, last in order; repeated rows and ties in the order count one by one; an empty
table gives an empty table; extra columns are ignored by plan() and kept by apply().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratapack.session import materialize

#: Documents of one source in one bucket of the running sum, and the least number of buckets.
BUCKET_ROWS = 65_536
LEAST_BUCKETS = 64


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, cap: float) -> DataFrame:
    """One row per source: source, n, source_size, weight, target."""
    per = sized.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").cast("long").alias("source_size"))
    # One row per source from here on; the windows below hold sources, never documents.
    everything = Window.orderBy(F.col("source").isNull(), "source")
    per = per.withColumn("weight", ((F.row_number().over(everything) - 1) % 3 + 1).cast("double")).withColumn("limit", cap * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").isNull(), "source")
    clamped = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("limit").over(clamped), F.lit(0.0))
    per = per.withColumn("level", left / F.sum("weight").over(rest))
    # The level is that of the first source which isn't clamped under its own level; if all are, cap everything.
    fits = F.col("level") <= F.col("limit") / F.col("weight")
    per = per.withColumn("fits", fits).withColumn("level", F.first(F.when(F.col("fits"), F.col("level")), ignorenulls=True).over(whole))
    target = F.coalesce(F.least(F.col("level") * F.col("weight"), F.col("limit")), F.col("limit"))
    return per.select("source", "n", "source_size", "weight", target.alias("target"))


def _keyed(docs: DataFrame, seed: int) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source"), size_of(F.col("text")).alias("size"), _key(seed))


def _key(seed: int) -> Column:
    return F.xxhash64(F.col("doc_id").cast("long"), F.lit(seed)).alias("key")


def _targets(spark: SparkSession, sized: DataFrame, cap: float) -> DataFrame:
    """One row per source: source, n, source_size, target, its whole repetitions, the rest in words, its buckets."""
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    targets = source_targets(sized, cap).withColumn("whole", F.least(F.floor(rate), F.lit(int(cap))))
    targets = targets.withColumn("part", F.col("target") - F.col("whole") * F.col("source_size"))
    targets = targets.withColumn("buckets", F.greatest(F.lit(LEAST_BUCKETS), F.ceil(F.col("n") / BUCKET_ROWS)))
    return materialize(spark, targets.drop("weight"), "targets")


def _bucket() -> Column:
    return F.pmod(F.xxhash64("d.key"), F.col("t.buckets")).alias("bucket")


def _repetitions(sized: DataFrame, targets: DataFrame, cap: float) -> DataFrame:
    """sized with source_size, target, whole, bucket and reps."""
    same_source = F.col("d.source").eqNullSafe(F.col("t.source"))
    dealt = sized.alias("d").join(targets.alias("t"), same_source).select("d.*", "t.source_size", "t.target", "t.whole", "t.part", _bucket())
    totals = dealt.groupBy("source", "bucket").agg(F.sum("size").alias("total"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("source", "bucket", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("offset"))
    inner = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    d = dealt.withColumn("before", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    d = d.alias("d").join(offsets.alias("o"), F.col("d.source").eqNullSafe(F.col("o.source")) & (F.col("d.bucket") == F.col("o.bucket")), "left").select("d.*", "o.offset")
    extra = (F.col("offset") + F.col("before") + F.col("size") / 2 <= F.col("part")) & (F.col("whole") < cap)
    return d.withColumn("reps", F.when(F.col("size") > 0, F.col("whole") + extra.cast("long")).otherwise(0).cast("long"))


def plan(spark: SparkSession, docs: DataFrame, cap: float = 3.0, seed: int = 42) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken."""
    sized = materialize(spark, _keyed(docs, seed), "sizes")
    reps = _repetitions(sized, _targets(spark, sized, cap), cap)
    return reps.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("reps")).alias("taken"))


def _cuts(spark: SparkSession, sized: DataFrame, targets: DataFrame, cap: float) -> DataFrame:
    """Per source whole, buckets and the last place taken once more: cut, with its m rows, of which k are taken.

    Documents' middles rise along the order, so those taken once more are its beginning, up to the cut.
    """
    at = F.struct("bucket", "key", "doc_id")
    places = _repetitions(sized, targets, cap).where("size > 0").groupBy("source", "bucket", "key", "doc_id")
    places = places.agg(F.count_if(F.col("reps") > F.col("whole")).alias("k"), F.count(F.lit(1)).alias("m")).where("k > 0")
    last = places.groupBy("source").agg(F.max(F.struct(at.alias("cut"), "k", "m")).alias("c"))
    out = targets.alias("t").join(last.alias("l"), F.col("t.source").eqNullSafe(F.col("l.source")), "left")
    return materialize(spark, out.select("t.source", "t.whole", "t.buckets", "l.c.cut", "l.c.k", "l.c.m"), "cuts")


def apply(spark: SparkSession, docs: DataFrame, cap: float = 3.0, seed: int = 42) -> DataFrame:
    """The mixed rows themselves, with all their columns, each as often as the mix takes it.

    Texts are not shuffled: each row is held against its source's cut. Only where rows share the id at
    a cut and not all of them are taken, those rows are numbered by size and text.
    """
    sized = materialize(spark, _keyed(docs, seed), "sizes")
    cuts = _cuts(spark, sized, _targets(spark, sized, cap), cap)
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "source", "text", _key(seed)).where(F.rlike("text", F.lit(r"[^\x20\x09-\x0D]")))
    rows = rows.alias("d").join(cuts.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")))
    rows = rows.select("d.*", "t.whole", "t.cut", "t.k", "t.m", F.struct(_bucket(), "d.key", "d.doc_id").alias("at"))
    split = F.coalesce((F.col("at") == F.col("cut")) & (F.col("k") < F.col("m")), F.lit(False))
    out = rows.where(~split).select("row", (F.col("whole") + F.coalesce(F.col("at") <= F.col("cut"), F.lit(False)).cast("long")).alias("reps"))
    if not cuts.where("k < m").isEmpty():
        number = F.row_number().over(Window.partitionBy("source").orderBy(size_of(F.col("text")), F.sha2("text", 256)))
        shared = rows.where(split).withColumn("number", number)
        out = out.unionByName(shared.select("row", (F.col("whole") + (F.col("number") <= F.col("k")).cast("long")).alias("reps")))
    return out.where("reps > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("reps")))).select("row.*")
