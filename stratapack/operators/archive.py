"""The archive: entries, spans and blocks as Parquet tables with a meta row, written, read and verified.

create -> dedup files -> route and transform -> chunk -> dedup blocks -> order and pack (metadata
only) -> compress groups (codec competition) -> layout -> tables. Payloads are joined with their
places and shuffled to their groups; originals are made from them where a group is stored raw.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratapack.functions import classify, codecs, hashing, transforms
from stratapack.operators import chunking, packing
from stratapack.operators.dedup import first_copy, resolve_copies
from stratapack.operators.ordering import running_totals
from stratapack.session import discard, materialize, ship_code
from stratapack.sources.tree import canonical_order, escapes

FORMAT_VERSION = 2
#: Fixed value: largest block, encoded or raw.
MAX_BLOCK = 2 << 30
GROUP_CAPS = {"compressible": 8 << 20, "executable": 4 << 20}
#: Payload bytes of a compression task at least, where small groups are many.
TASK_BYTES = 2 << 20
#: Ids and groups up to this count are broadcast, more are shuffled.
FEW = 100_000
#: Spans in one list of a block.
SPANS = 20_000


@dataclass(frozen=True)
class Options:
    level: str = "balanced"
    spec: str | None = None
    verify: bool | None = None
    #: whole files are transformed, then chunked; or chunked, then each chunk transformed
    scope: str = "file"
    gear_chunks: bool = False

    @property
    def codecs(self) -> list[str]:
        return codecs.parse_spec(self.spec or codecs.LEVELS[self.level][0])

    @property
    def verified(self) -> bool:
        return codecs.LEVELS[self.level][1] if self.verify is None else self.verify


def prepare(files: DataFrame, o: Options) -> DataFrame:
    """Blocks of each file: file_id, path, block_idx, payload, transforms, recipe, raw, both sizes and digests, fingerprint.

    Whether a file is text, which needs every byte, is found where the bytes are cut and transformed: the
    columns give the route for either case. The original of a changed payload isn't kept, since apply_verified
    has seen that reverse() gives it back.
    """
    c, p = F.col("content"), F.col("path")
    cases = [x for text in (False, True) for x in (classify.route(c, p, o.level, F.lit(text)).alias(f"route_{text:d}"), classify.should_chunk(c, p, F.lit(text)).alias(f"chunk_{text:d}"))]
    cut = chunking.gear_cut_points if o.gear_chunks else chunking.cut_points
    in_chunks = o.scope == "chunk"

    def blocks(file_id: int, path: str, data: bytes, raw: bool, routes: tuple, chunks: tuple) -> Iterator[tuple]:
        text = classify.is_text_bytes(data)
        name, ends = routes[text], [len(data)]
        chunked = name == "chunk" or in_chunks and bool(chunks[text])
        if chunked:
            ends, name, raw = cut(data), "dictionary" if in_chunks else "none", False
        for i, (x, y) in enumerate(zip([0, *ends], ends, strict=False)):
            part = data[x:y] if chunked else data
            got = transforms.apply_verified(name, part)
            payload, recipe = got or (part, None)
            digest = hashlib.sha256(payload).hexdigest()
            marks = ["chunk"] * chunked + ([name] if got else [])
            yield file_id, path, i, payload, marks, recipe, bool(raw), len(payload), len(part), digest, hashlib.sha256(part).hexdigest() if got else digest, packing.sparse_histogram(payload)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for b in batches:
            for *of, raw, r0, c0, r1, c1 in zip(*(b.column(i) for i in range(b.num_columns)), strict=True):
                for row in blocks(*(x.as_py() for x in of), raw.as_py(), (r0.as_py(), r1.as_py()), (c0.as_py(), c1.as_py())):
                    rows.append(row)
                    held += len(row[3])
                    if held > HELD:
                        yield _batch(rows, BLOCKS)
                        rows, held = [], 0
        if rows:
            yield _batch(rows, BLOCKS)

    return files.select("file_id", "path", "content", classify.prefers_raw(c, p).alias("raw"), *cases).mapInArrow(run, _ddl(BLOCKS))


#: Bytes of payloads in one batch that leaves a Python worker.
HELD = 8 << 20
DDL = {pa.int64(): "long", pa.int32(): "int", pa.string(): "string", pa.binary(): "binary", pa.bool_(): "boolean", pa.list_(pa.string()): "array<string>"}
BLOCKS = {
    "file_id": pa.int64(), "path": pa.string(), "block_idx": pa.int32(), "payload": pa.binary(), "transforms": pa.list_(pa.string()), "recipe": pa.binary(), "raw": pa.bool_(),
    "payload_size": pa.int64(), "fallback_size": pa.int64(), "p_ck": pa.string(), "f_ck": pa.string(), "fingerprint": pa.binary(),
}
GROUPS = {"segment": pa.string(), "group_no": pa.int64(), "storage": pa.string(), "codec": pa.string(), "encoded_size": pa.int64(), "raw_size": pa.int64(), "data": pa.binary(), "checksum": pa.string()}
PARTS = {"file_id": pa.int64(), "span_idx": pa.int32(), "data": pa.binary()}


def _batch(rows: list[tuple], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types.values(), strict=True)], list(types))


def _ddl(types: dict[str, pa.DataType]) -> str:
    return ", ".join(f"{name} {DDL[t]}" for name, t in types.items())


def _compress(o: Options):
    """Groups of a partition that is sorted by group and position, one after the other."""
    spec, check = o.codecs, o.verified

    def group(segment: str, group_no: int, rows: list[dict]) -> tuple:
        payload = b"".join([r["payload"] for r in rows])
        stored = any(r["raw"] for r in rows)
        if not stored:
            ext = segment.split(":", 1)[1].rsplit(":", 1)[0]  # that of the group's first file, and of all others
            name, data = codecs.compete(payload, codecs.choose(spec, ext.lower() in classify.STRONGER_EXTENSIONS))
            if check and codecs.CODECS[name][1](data) != payload:
                raise ValueError(f"{name} doesn't give back group {segment}")
            stored = len(data) >= sum(r["fallback_size"] for r in rows)
        if stored:
            name = "stored"
            data = payload = b"".join([transforms.reverse([t for t in r["transforms"] if t != "chunk"], r["payload"], r["recipe"]) for r in rows])
        return segment, group_no, "raw" if stored else "compressed", name, len(data), len(payload), data, hashlib.sha256(data).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in b.to_pylist())
        for key, of in groupby(rows, lambda r: (r["segment"], r["group_no"])):
            yield _batch([group(*key, list(of))], GROUPS)

    return run


@dataclass
class Archive:
    """The archive's tables; blocks has the data column, which readers that don't need it never scan."""

    entries: DataFrame
    spans: DataFrame
    blocks: DataFrame
    codecs: list[str]


def build(spark: SparkSession, files: DataFrame, o: Options = Options()) -> Archive:
    """files: file_id, path, kind, content (null for directories) and any metadata columns."""
    ship_code(spark)
    more = [c for c in files.columns if c not in ("file_id", "path", "kind", "content")]
    entries = files.select("file_id", "path", "kind", *more, F.coalesce(classify.size(F.col("content")), F.lit(0)).alias("size"), F.when(F.col("kind") == "file", hashing.content_digest(F.coalesce("content", F.lit(b"")))).alias("content_ck"))
    digests = materialize(spark, entries, "digests")  # contents are read and hashed once
    entries = materialize(spark, first_copy(digests, F.when(F.col("kind") == "file", F.col("content_ck")).otherwise(F.col("path")), F.col("file_id"), "same_as"), "entries")
    discard(spark, digests)
    copies = entries.where("kind = 'file' AND file_id <> same_as").select("file_id")
    few = copies.limit(FEW + 1).count() <= FEW  # then the contents stay where they are
    sources = files.where("kind = 'file'").withColumn("content", F.coalesce("content", F.lit(b""))).join(F.broadcast(copies) if few else copies, "file_id", "left_anti")
    key = hashing.block_key("p_ck", "f_ck", "transforms", F.sha2("recipe", 256).alias("recipe"), "raw")
    blocks = materialize(spark, prepare(sources, o).withColumn("block_key", key), "blocks", "zstd")
    firsts = blocks.groupBy("block_key").agg(F.min(F.struct("path", "block_idx", "file_id")).alias("f"))
    firsts = firsts.select("block_key", F.col("f.file_id").alias("file_id"), F.col("f.block_idx").alias("block_idx"))
    items = blocks.join(firsts, ["block_key", "file_id", "block_idx"])
    items = materialize(spark, items.select(F.col("block_key").alias("item_id"), "file_id", "block_idx", classify.raw_extension(F.col("path")).alias("ext"), classify.pack_bucket(F.col("path")).alias("bucket"), F.concat("path", F.lit("\x00"), F.lpad(F.col("block_idx").cast("string"), 9, "0")).alias("path"), F.col("payload_size").alias("size"), "fallback_size", "raw", "fingerprint"), "items")
    order = packing.similarity_order(items).select("item_id", "run_no", "position")
    ordered = materialize(spark, items.drop("fingerprint").join(order, "item_id").withColumn("segment", F.concat_ws(":", "bucket", "ext", "run_no")), "ordered")
    packed = packing.pack(ordered, GROUP_CAPS).withColumnRenamed("group_in_segment", "group_no")
    packed = materialize(spark, packed.join(ordered.select("item_id", "file_id", "block_idx", "position", "size"), "item_id"), "packed")
    groups = packed.groupBy("segment", "group_no").agg(F.sum("size").alias("bytes"))
    groups = running_totals(spark, groups, [F.desc("bytes"), F.col("segment"), F.col("group_no")]).select("segment", "group_no", F.col("position").alias("nth"))
    count, total = packed.agg(F.count_distinct("segment", "group_no"), F.coalesce(F.sum("size"), F.lit(0))).first()
    tasks = max(1, min(count, 2 * spark.sparkContext.defaultParallelism + total // TASK_BYTES))
    places = packed.join(groups, ["segment", "group_no"]).select("file_id", "block_idx", "segment", "group_no", "nth", "position")
    payloads = blocks.select("file_id", "block_idx", "payload", "transforms", "recipe", "raw", "fallback_size").join(places, ["file_id", "block_idx"])
    # largest groups first, dealt out one by one: a hash would put several into one task and none into others
    dealt = payloads.repartitionById(tasks, F.pmod("nth", F.lit(tasks)).cast("int")).sortWithinPartitions("nth", "position")
    dealt = dealt.select("segment", "group_no", "payload", "transforms", "recipe", "raw", "fallback_size")
    out = materialize(spark, dealt.mapInArrow(_compress(o), _ddl(GROUPS)), "groups", "uncompressed")
    out = out.withColumn("block_id", F.sha2(F.concat_ws(":", "codec", "checksum"), 256))
    same = out.groupBy("block_id").agg(F.min(F.struct("segment", "group_no")).alias("g"))
    kept = out.drop("data").join(same, "block_id").where((F.col("g.segment") == F.col("segment")) & (F.col("g.group_no") == F.col("group_no"))).drop("g")
    placed = running_totals(spark, kept, [F.col("segment"), F.col("group_no")], F.col("encoded_size"))
    placed = placed.select("segment", "group_no", F.col("position").alias("group_seq"), F.col("before").alias("payload_offset"))
    tables = out.join(F.broadcast(placed) if count <= FEW else placed, ["segment", "group_no"])
    tables = tables.select("block_id", "group_seq", "payload_offset", "encoded_size", "raw_size", "storage", "codec", "checksum", "data")
    where = packed.select(F.col("item_id").alias("block_key"), "segment", "group_no", "payload_offset", "fallback_offset").join(out.select("segment", "group_no", "block_id", "storage"), ["segment", "group_no"])
    stored = F.col("storage") == "raw"
    spans = resolve_copies(blocks.select("file_id", "block_idx", "block_key", "transforms", "recipe", "payload_size", "fallback_size", "p_ck", "f_ck"), where)
    spans = spans.select("file_id", F.col("block_idx").alias("span_idx"), "block_id", F.when(stored, F.col("fallback_offset")).otherwise(F.col("payload_offset")).alias("offset"), F.when(stored, F.col("fallback_size")).otherwise(F.col("payload_size")).alias("size"), F.when(stored, F.col("f_ck")).otherwise(F.col("p_ck")).alias("checksum"), F.when(stored, F.filter("transforms", lambda t: t == "chunk")).otherwise(F.col("transforms")).alias("transforms"), F.when(~stored, F.col("recipe")).alias("recipe"))
    spans = materialize(spark, spans, "spans")
    for t in (blocks, items, ordered, packed):
        discard(spark, t)
    return Archive(entries, spans, tables, o.codecs)


def manifest_checksum(a: Archive) -> str:
    """Order-free digest of all manifest rows: count, sum and xor of row hashes per table."""
    parts = []
    for t in (a.entries, a.spans, a.blocks.drop("data")):
        cols = [F.to_json(F.col(c)) if dict(t.dtypes)[c].startswith("array") else F.col(c).cast("string") if dict(t.dtypes)[c] != "binary" else F.hex(c) for c in sorted(t.columns)]
        h = F.xxhash64(*cols)
        r = t.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(h), F.lit(0)), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0))).first()
        parts.append(":".join(map(str, r)))
    return "|".join(parts)


def write(spark: SparkSession, a: Archive, path: str, created_utc: str | None = None) -> None:
    """Tables and meta into a staging folder, renamed when whole. The time stamp is in no digest."""
    staging = f"{path}.{uuid.uuid4().hex}.tmp"
    for name, t in (("entries", a.entries), ("spans", a.spans), ("blocks", a.blocks)):
        t.write.option("compression", "zstd").parquet(f"{staging}/{name}")
    row = [(FORMAT_VERSION, ",".join(a.codecs), manifest_checksum(a), created_utc)]
    spark.createDataFrame(row, "format_version int, codecs string, checksum string, created_utc string").coalesce(1).write.json(f"{staging}/_meta")
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(p) or not fs.rename(jvm.org.apache.hadoop.fs.Path(staging), p):
        fs.delete(jvm.org.apache.hadoop.fs.Path(staging), True)
        raise FileExistsError(path)


def _stored_bytes(spark: SparkSession, path: str) -> int:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p).getLength()


def read_manifest(spark: SparkSession, path: str, check: bool = True, max_manifest: int | None = None, max_payload: int | None = None) -> Archive:
    """The archive's tables, refused if the format, a codec, a size or the manifest's digest doesn't hold.

    max_manifest and max_payload bound the stored bytes of the manifest and the sum of the blocks; a
    single block may never be larger than MAX_BLOCK.
    """
    meta = spark.read.schema("format_version int, codecs string, checksum string, created_utc string").json(f"{path}/_meta").first()
    if meta is None or meta["format_version"] is None:
        raise ValueError("not an archive")
    if not 1 <= meta["format_version"] <= FORMAT_VERSION:
        raise ValueError(f"unknown format version {meta['format_version']}")
    a = Archive(*[spark.read.parquet(f"{path}/{t}") for t in ("entries", "spans", "blocks")], meta["codecs"].split(","))
    for name in a.codecs:
        if name != codecs.SELECTIVE:
            codecs.codec(name)
    if max_manifest is not None and sum(_stored_bytes(spark, f"{path}/{t}") for t in ("entries", "spans")) > max_manifest:
        raise ValueError("manifest is too large")
    total, largest = a.blocks.agg(F.coalesce(F.sum("encoded_size"), F.lit(0)), F.coalesce(F.max(F.greatest("encoded_size", "raw_size")), F.lit(0))).first()
    if largest > MAX_BLOCK or max_payload is not None and total > max_payload:
        raise ValueError("payload is too large")
    if check and manifest_checksum(a) != meta["checksum"]:
        raise ValueError("manifest checksum mismatch")
    return a


def legacy_spans(entries: DataFrame, blocks: DataFrame) -> DataFrame:
    """Version 1 entries list block ids only: each becomes a span over its whole block."""
    one = entries.select("file_id", F.posexplode("block_ids").alias("span_idx", "block_id"))
    return one.join(blocks.select("block_id", "raw_size", "transforms", "recipe"), "block_id", "left").select("file_id", "span_idx", "block_id", F.lit(0).cast("long").alias("offset"), F.col("raw_size").alias("size"), F.lit(None).cast("string").alias("checksum"), "transforms", "recipe")


def structural_faults(a: Archive) -> DataFrame:
    """fault, id: what makes an archive unreadable, found by joins before anything is decoded."""
    missing = a.spans.join(a.blocks.select("block_id"), "block_id", "left_anti").select(F.lit("missing block").alias("fault"), F.col("file_id").cast("string").alias("id"))
    twice = a.blocks.groupBy("block_id").count().where("count > 1").select(F.lit("duplicate block").alias("fault"), F.col("block_id").alias("id"))
    owners = a.spans.select(F.col("file_id").alias("same_as")).distinct()
    empty = a.entries.where("kind = 'file'").join(owners, "same_as", "left_anti").select(F.lit("file without blocks").alias("fault"), F.col("file_id").cast("string").alias("id"))
    sizes = a.blocks.select("block_id", "raw_size").join(a.spans, "block_id").where((F.col("offset") < 0) | (F.col("offset") + F.col("size") > F.col("raw_size")))
    outside = sizes.select(F.lit("span out of range").alias("fault"), F.col("file_id").cast("string").alias("id"))
    total = a.blocks.agg(F.sum("encoded_size").alias("total"))
    beyond = (F.col("payload_offset") < 0) | (F.col("encoded_size") < 0) | (F.col("payload_offset") + F.col("encoded_size") > F.col("total"))
    placed = a.blocks.select("block_id", "payload_offset", "encoded_size").crossJoin(F.broadcast(total)).where(beyond)  # total is one row
    outside = outside.unionByName(placed.select(F.lit("block out of range").alias("fault"), F.col("block_id").alias("id")))
    paths = a.entries.where(escapes(F.col("path"))).select(F.lit("path leaves the destination").alias("fault"), F.col("path").alias("id"))
    return missing.unionByName(twice).unionByName(empty).unionByName(outside).unionByName(paths).distinct()


def _spans_by_block(spans: DataFrame) -> DataFrame:
    """block_id, spans: lists of a block's spans, of SPANS or about so many at most, for blocks that many files share."""
    many = spans.groupBy("block_id").agg(F.count(F.lit(1)).alias("n")).select("block_id", F.ceil(F.col("n") / SPANS).alias("lists"))
    dealt = spans.join(many, "block_id").withColumn("list", F.pmod(F.xxhash64("file_id", "span_idx"), F.col("lists")))
    return dealt.groupBy("block_id", "list").agg(F.collect_list(F.struct("file_id", "span_idx", "offset", "size", "checksum", "transforms", "recipe")).alias("spans")).drop("list")


def decode_spans(a: Archive) -> DataFrame:
    """file_id, span_idx, data (null if damaged): a block is decoded where its list of spans is, so it never travels decoded."""

    def raw(r: dict) -> bytes | None:
        try:
            data = r["data"] if r["codec"] == "stored" else codecs.codec(r["codec"])[1](r["data"])
            return data if r["intact"] and len(data) == r["raw_size"] else None
        except Exception:  # noqa: BLE001 - whatever a codec throws on damaged data
            return None

    def one(block: bytes | None, s: dict) -> bytes | None:
        try:
            data = block[s["offset"] : s["offset"] + s["size"]]
            if s["checksum"] is not None and hashlib.sha256(data).hexdigest() != s["checksum"]:
                return None
            return transforms.reverse([t for t in s["transforms"] if t != "chunk"], data, s["recipe"])
        except Exception:  # noqa: BLE001 - a lost block or a damaged recipe
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pylist()[0]
                block, rows, held = raw(r), [], 0
                for s in r["spans"]:
                    rows.append((s["file_id"], s["span_idx"], one(block, s)))
                    held += len(rows[-1][2] or b"")
                    if held > HELD:
                        yield _batch(rows, PARTS)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows, PARTS)

    blocks = a.blocks.select("block_id", "codec", "raw_size", "data", (F.sha2("data", 256) == F.col("checksum")).alias("intact"))
    return _spans_by_block(a.spans).join(blocks, "block_id", "left").drop("block_id").mapInArrow(run, _ddl(PARTS))


def restore(a: Archive) -> DataFrame:
    """file_id, path, kind, size, content, ok: every entry with its bytes, and whether all checks held."""
    parts = decode_spans(a)
    whole = parts.groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("span_idx", "data"))).alias("p"))
    joined = F.aggregate("p", F.lit(b""), lambda s, x: F.concat(s, x["data"]))
    whole = whole.select(F.col("file_id").alias("same_as"), joined.alias("content"))
    out = a.entries.join(whole, "same_as", "left")
    ok = (F.col("kind") != "file") | F.coalesce(F.sha2("content", 256) == F.col("content_ck"), F.lit(False))
    return out.select("file_id", "path", "kind", *[c for c in ("mtime_ns",) if c in a.entries.columns], "size", "content", ok.alias("ok"))


def verify(a: Archive) -> DataFrame:
    """The same plan without the bytes: path, ok."""
    return restore(a).select("file_id", "path", "kind", "size", "ok")


def entry_list(spark: SparkSession, a: Archive) -> DataFrame:
    """Entries in canonical order with their number."""
    return running_totals(spark, a.entries, canonical_order())
