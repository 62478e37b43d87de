"""The engine's own queries: each over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratapack.functions import classify, codecs, hashing, transforms
from stratapack.operators import archive, benchmark, chunking, dedup, ordering, packing, tokens
from stratapack.session import removed_at_exit, shared_dir, ship_code
from stratapack.sources import views
from stratapack.sources.tree import canonical_order, escapes

BLOCK = 1024
SOLID_CAP = 65_536
LEGACY_SPAN = 1000


def _size() -> Column:
    return classify.size(F.col("content"))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """What is stored, where, and what is a copy of what: the manifest of all documents."""
    files = views.doc_files(spark, sf).withColumn("size", _size()).withColumn("text", classify.is_text(classify.printable_bytes(F.col("content")), _size()))
    rows = files.select("file_id", "path", "kind", "size", "text", hashing.content_digest(F.col("content")).alias("content_ck"))
    rows = dedup.first_copy(rows, F.col("content_ck"), F.col("file_id"), "stored_as")
    own = F.when(F.col("stored_as") == F.col("file_id"), F.col("size")).otherwise(0)
    return ordering.running_totals(spark, rows, [F.col("file_id")], own).select("file_id", "path", "size", "text", "content_ck", "stored_as", F.col("before").alias("stored_before"))


def scan_canonical_order(spark, sf):
    rows = views.doc_files(spark, sf).select("path", "kind", _size().alias("size"))
    return ordering.running_totals(spark, rows, canonical_order(), F.col("size")).select("path", "size", "position", F.col("before").alias("bytes_before"))


def classify_text(spark, sf):
    d = views.table(spark, sf, "documents")
    n, p = F.octet_length("text").cast("long"), classify.printable_bytes_of_text(F.col("text"))
    return d.select("doc_id", n.alias("size"), p.alias("printable"), classify.is_text(p, n).alias("is_text"))


def route_matrix(spark, sf):
    f = views.probe_files(spark)
    c, p = F.col("content"), F.col("path")
    return f.select("path", classify.extension(p).alias("ext"), classify.prefers_raw(c, p).alias("raw"), classify.branch_filter(c).alias("branch"), classify.pack_bucket(p).alias("bucket"), classify.route(c, p, "balanced").alias("route"), classify.route(c, p, "fast").alias("route_fast"))


def route_counts(spark, sf):
    f = views.all_files(spark, sf)
    r = f.select(classify.extension(F.col("path")).alias("ext"), classify.route(F.col("content"), F.col("path")).alias("route"), _size().alias("size"))
    return r.groupBy("ext", "route").agg(F.count(F.lit(1)).alias("files"), F.sum("size").cast("long").alias("bytes"))


def extension_stats(spark, sf):
    f = views.all_files(spark, sf).unionByName(views.conv_files(spark, sf))
    return f.groupBy(classify.extension(F.col("path")).alias("ext")).agg(F.count(F.lit(1)).alias("files"), F.sum(_size()).cast("long").alias("bytes"))


def content_digest(spark, sf):
    return views.doc_files(spark, sf).select(F.col("file_id").alias("doc_id"), hashing.content_digest(F.col("content")).alias("sha256"))


def fnv_checksum(spark, sf):
    ship_code(spark)
    return views.doc_files(spark, sf).select(F.col("file_id").alias("doc_id"), hashing.fnv_checksum("content").alias("fnv"))


def rolling_hash(spark, sf):
    ship_code(spark)
    return views.doc_files(spark, sf).select(F.col("file_id").alias("doc_id"), hashing.rolling_hash("content").alias("h"))


def _digests(spark, sf):
    d = views.table(spark, sf, "documents")
    return d.select("doc_id", "source", F.octet_length("text").cast("long").alias("size"), F.sha2("text", 256).alias("ck"))


def file_dedup(spark, sf):
    return dedup.first_copy(_digests(spark, sf), F.col("ck"), F.col("doc_id"), "first_id").select("doc_id", "first_id", (F.col("doc_id") != F.col("first_id")).alias("is_copy"))


def dedup_savings(spark, sf):
    d = dedup.first_copy(_digests(spark, sf), F.col("ck"), F.col("doc_id"), "first_id")
    copy = F.col("doc_id") != F.col("first_id")
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("files"), F.count_if(copy).alias("copies"), F.sum("size").cast("long").alias("bytes"), F.coalesce(F.sum(F.when(copy, F.col("size"))), F.lit(0)).cast("long").alias("saved"))


def block_dedup(spark, sf):
    b = dedup.fixed_blocks(views.doc_files(spark, sf), BLOCK)
    b = b.select("file_id", "block_idx", "size", F.sha2("data", 256).alias("ck"))
    b = dedup.first_copy(b, F.col("ck"), F.struct("file_id", "block_idx"), "first")
    own = (F.col("first.file_id") == F.col("file_id")) & (F.col("first.block_idx") == F.col("block_idx"))
    return b.groupBy(F.col("file_id").alias("doc_id")).agg(F.count(F.lit(1)).alias("blocks"), F.count_if(own).alias("own_blocks"), F.coalesce(F.sum(F.when(own, F.col("size"))), F.lit(0)).cast("long").alias("own_bytes"))


def token_dictionary(spark, sf):
    return tokens.token_dictionary(views.table(spark, sf, "documents"), "doc_id", F.col("text"))


def dictionary_roundtrip(spark, sf):
    ship_code(spark)
    f = views.doc_files(spark, sf).withColumn("t", transforms.apply_transform(F.col("content"), F.lit("dictionary")))
    back = transforms.reverse_transform(F.col("t.payload"), F.col("t.recipe"), F.col("t.applied"))
    return f.select(F.col("file_id").alias("doc_id"), F.octet_length("t.payload").cast("long").alias("encoded_size"), F.sha2(back, 256).alias("restored_sha256"))


def gzip_normalize(spark, sf):
    ship_code(spark)
    f = views.probe_files(spark).where(classify.is_plain_gzip(F.col("content"))).withColumn("t", transforms.apply_transform(F.col("content"), F.lit("gzip")))
    back = transforms.reverse_transform(F.col("t.payload"), F.col("t.recipe"), F.col("t.applied"))
    return f.select("path", F.hex("t.payload").alias("payload"), F.decode("t.recipe", "UTF-8").alias("recipe"), F.hex(back).alias("restored"))


def _roundtrip(spark, files: DataFrame, names: list[str]) -> DataFrame:
    ship_code(spark)
    f = files.withColumn("name", F.explode(F.array(*map(F.lit, names)))).withColumn("t", transforms.apply_transform(F.col("content"), F.col("name")))
    back = transforms.reverse_transform(F.col("t.payload"), F.col("t.recipe"), F.col("t.applied"))
    return f.groupBy(F.col("name").alias("transform")).agg(F.count(F.lit(1)).alias("files"), F.count_if(back == F.col("content")).alias("restored"), F.sum(_size()).cast("long").alias("bytes"))


def delta_roundtrip(spark, sf):
    return _roundtrip(spark, views.vec_files(spark, sf), ["delta"])


def branch_roundtrip(spark, sf):
    return _roundtrip(spark, views.vec_files(spark, sf), ["branch_x86", "branch_arm64", "branch_arm", "branch_thumb"])


def byte_histogram(spark, sf):
    ship_code(spark)
    return packing.byte_histogram(views.table(spark, sf, "documents"), ["lang"], F.encode("text", "UTF-8"))


def entropy(spark, sf):
    ship_code(spark)
    h = packing.byte_histogram(views.table(spark, sf, "documents"), ["source"], F.encode("text", "UTF-8"))
    return packing.entropy(h, ["source"]).withColumn("entropy", F.round("entropy", 6))


def cosine_neighbors(spark, sf):
    """Every vector's most similar label centre; one centre per label is joined to all vectors."""
    e = views.table(spark, sf, "embeddings")
    dims = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    centres = dims.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("c")).select(F.col("label").alias("centre"), "c")
    s = e.crossJoin(centres).select("vec_id", "centre", (packing.cosine(F.col("embedding"), F.col("c")) / (norm(F.col("embedding")) * norm(F.col("c")))).alias("s"))
    best = s.groupBy("vec_id").agg(F.max_by("centre", "s").cast("long").alias("nearest_label"), F.max("s").alias("s"))
    return best.select("vec_id", "nearest_label", F.round("s", 6).alias("similarity"))


def _items(spark, sf):
    f = views.doc_files(spark, sf)
    return f.select(F.col("file_id").cast("string").alias("item_id"), classify.raw_extension(F.col("path")).alias("ext"), "path", _size().alias("size"), packing.fingerprint("content").alias("fingerprint"))


def similarity_chain(spark, sf):
    ship_code(spark)
    o = packing.similarity_order(_items(spark, sf))
    return o.groupBy("ext", "run_no").agg(F.count(F.lit(1)).alias("items"), F.count_distinct("item_id").alias("distinct_items"), F.count_distinct("position").alias("positions"), F.max("position").alias("last_position"))


def solid_groups(spark, sf):
    """Runs of a source's documents by path, packed up to a cap."""
    ship_code(spark)
    f = views.doc_files(spark, sf).select(F.col("file_id").cast("string").alias("item_id"), F.element_at(F.split("path", "/"), 3).alias("source"), "path", _size().alias("size"))
    placed = packing.runs(f, "source").join(f.drop("source"), "item_id").withColumn("segment", F.concat_ws(":", "source", "run_no"))
    items = placed.select("item_id", "segment", F.col("place").alias("position"), classify.pack_bucket(F.col("path")).alias("bucket"), "size", F.col("size").alias("fallback_size"), F.lit(False).alias("raw"))
    p = packing.pack(items, {"compressible": SOLID_CAP, "executable": SOLID_CAP})
    parts = F.split("segment", ":(?=[0-9]+$)")
    return p.select(F.col("item_id").cast("long").alias("doc_id"), parts[0].alias("source"), parts[1].cast("long").alias("run_no"), F.col("group_in_segment").alias("group_no"), "payload_offset")


def cdc_chunks(spark, sf):
    ship_code(spark)
    f = views.bundle_files(spark, sf)
    c = chunking.chunk_files(f)
    last = F.max("chunk_idx").over(Window.partitionBy("file_id"))
    c = c.withColumn("fits", (F.col("size") <= chunking.MAX_CHUNK) & ((F.col("chunk_idx") == last) | (F.col("size") >= chunking.MIN_CHUNK)))
    g = c.groupBy("file_id").agg(F.sum("size").cast("long").alias("size"), F.bool_and("fits").alias("bounds_hold"), F.sort_array(F.collect_list(F.struct("chunk_idx", "data"))).alias("parts"))
    whole = F.aggregate("parts", F.lit(b""), lambda s, x: F.concat(s, x["data"]))
    return f.select("file_id", "path").join(g, "file_id").select("path", "size", "bounds_hold", F.sha2(whole, 256).alias("restored_sha256"))


def chunk_dedup(spark, sf):
    """Chunks of all bundles: how many, and how many bytes are left when equal chunks are kept once."""
    ship_code(spark)
    c = chunking.chunk_files(views.bundle_files(spark, sf)).select("file_id", "chunk_idx", "size", "digest")
    c = dedup.first_copy(c, F.col("digest"), F.struct("file_id", "chunk_idx"), "first")
    own = (F.col("first.file_id") == F.col("file_id")) & (F.col("first.chunk_idx") == F.col("chunk_idx"))
    return c.agg(F.count(F.lit(1)).alias("chunks"), F.count_if(own).alias("own_chunks"), F.sum(F.when(own, F.col("size"))).cast("long").alias("own_bytes"), F.sum("size").cast("long").alias("bytes"))


def block_layout(spark, sf):
    d = dedup.first_copy(_digests(spark, sf), F.col("ck"), F.col("doc_id"), "first_id").where("doc_id = first_id")
    return ordering.running_totals(spark, d.select("doc_id", "size"), [F.col("doc_id")], F.col("size")).select("doc_id", F.col("position").alias("block_no"), F.col("before").alias("payload_offset"))


def codec_best_of_n(spark, sf):
    """Each bundle through every codec of the widest level: the arg-min, earlier codec on ties, and its round trip."""
    ship_code(spark)
    spec = codecs.parse_spec(codecs.LEVELS["insane"][0])

    @F.pandas_udf("struct<size: long, good: boolean>", F.PandasUDFType.SCALAR)
    def trial(content, name):
        import pandas as pd

        rows = []
        for d, n in zip(content, name, strict=True):
            out = codecs.codec(n)[0](bytes(d))
            rows.append((len(out), codecs.codec(n)[1](out) == bytes(d)))
        return pd.DataFrame(rows, columns=["size", "good"])

    f = views.bundle_files(spark, sf).select("path", "content", F.posexplode(F.array(*map(F.lit, spec))).alias("priority", "codec"))
    t = f.select("path", "priority", "codec", F.octet_length("content").cast("long").alias("raw_size"), trial("content", "codec").alias("t"))
    g = t.groupBy("path").agg(F.min(F.struct(F.col("t.size").alias("size"), "priority", "codec")).alias("w"), F.min("t.size").alias("least"), F.bool_and("t.good").alias("round_trips"), F.max("raw_size").alias("raw_size"))
    return g.select("path", "raw_size", "round_trips", (F.col("w.size") == F.col("least")).alias("winner_is_least"), (F.col("w.size") < F.col("raw_size")).alias("shrinks"))


def codec_selective(spark, sf):
    f = views.probe_files(spark).select("path").unionByName(views.all_files(spark, sf).select("path"))
    ext = classify.extension(F.col("path"))
    g = f.select(ext.alias("ext"), F.when(classify.stronger_level(F.col("path")), codecs.STRONG).otherwise(codecs.LIGHT).alias("codec"))
    return g.groupBy("ext", "codec").agg(F.count(F.lit(1)).alias("files"))


def _archive(spark, sf):
    return archive.build(spark, views.all_files(spark, sf), archive.Options("fast"))


def archive_roundtrip(spark, sf):
    r = archive.restore(_archive(spark, sf))
    return r.select("path", "size", F.sha2("content", 256).alias("sha256"), "ok")


def _restored(spark, sf, o: archive.Options) -> DataFrame:
    """All files through create, write, manifest read and restore."""
    path = f"{shared_dir(spark)}/stratapack-{uuid.uuid4().hex}"
    archive.write(spark, archive.build(spark, views.all_files(spark, sf), o), path)
    removed_at_exit(spark, path)
    r = archive.restore(archive.read_manifest(spark, path))
    return r.select("path", "size", F.sha2("content", 256).alias("sha256"), "ok")


def archive_write_read(spark, sf):
    return _restored(spark, sf, archive.Options("fast"))


def archive_balanced(spark, sf):
    return _restored(spark, sf, archive.Options("balanced"))


def archive_max(spark, sf):
    return _restored(spark, sf, archive.Options("max"))


def archive_insane(spark, sf):
    return _restored(spark, sf, archive.Options("insane"))


def archive_chunk_scope(spark, sf):
    return _restored(spark, sf, archive.Options("balanced", scope="chunk"))


def archive_verify(spark, sf):
    a = _archive(spark, sf)
    v = archive.verify(a).agg(F.count(F.lit(1)).alias("files"), F.count_if(~F.col("ok")).alias("bad"), F.sum("size").cast("long").alias("bytes"))
    used = a.blocks.agg(F.bool_or(F.col("storage") == "compressed").alias("uses_codec"), F.sum("raw_size").alias("_r"))
    return v.crossJoin(archive.structural_faults(a).agg(F.count(F.lit(1)).alias("faults"))).crossJoin(used.select("uses_codec"))


def archive_tamper(spark, sf):
    """Spans of every seventh file get a wrong checksum: those files and their copies fail, no others."""
    a = _archive(spark, sf)
    wrong = a.spans.withColumn("checksum", F.when(F.col("file_id") % 7 == 0, F.lit("0")).otherwise(F.col("checksum")))
    return archive.verify(archive.Archive(a.entries, wrong, a.blocks, a.codecs)).where("NOT ok").select("path")


def missing_blocks(spark, sf):
    """Spans of every eleventh file point to no block: exactly those are reported."""
    a = _archive(spark, sf)
    lost = a.spans.withColumn("block_id", F.when(F.col("file_id") % 11 == 0, F.lit("none")).otherwise(F.col("block_id")))
    return archive.structural_faults(archive.Archive(a.entries, lost, a.blocks, a.codecs)).select("fault", "id")


def roundtrip_multiset(spark, sf):
    """Digests before and after as multisets: rows that either side has more of."""
    before = views.all_files(spark, sf).select(F.sha2("content", 256).alias("ck"))
    after = archive.restore(_archive(spark, sf)).select(F.sha2("content", 256).alias("ck"))
    n = lambda d, name: d.agg(F.count(F.lit(1)).alias(name))
    return n(before, "files").crossJoin(n(before.exceptAll(after), "lost")).crossJoin(n(after.exceptAll(before), "made_up"))


PATHS = ["a/b.txt", ".", "/etc/passwd", "..", "a/../b", "a/..b/c", "C:\\x", "\\\\share\\x", "a\\..\\b", "..a", "a/..", ""]


def path_guard(spark, sf):
    return spark.createDataFrame([(p,) for p in PATHS], "path string").select("path", escapes(F.col("path")).alias("refused"))


STAMPS = ["zpaq-m5", "zpaq-m12", "zpaq", "lzma", "zpaq-mx"]


def stamp_parse(spark, sf):
    return spark.createDataFrame([(s,) for s in STAMPS], "stamp string").select("stamp", hashing.zpaq_level(F.col("stamp")).cast("long").alias("level"))


def dictionary_sizes(spark, sf):
    d = views.table(spark, sf, "lineitem").select((F.col("l_orderkey") * F.col("l_partkey")).alias("n")).distinct()
    return d.groupBy(classify.dictionary_size(F.col("n")).alias("dictionary_size")).agg(F.count(F.lit(1)).alias("inputs"))


def legacy_spans(spark, sf):
    """Entries of the old layout, each the documents of one source within LEGACY_SPAN ids."""
    d = views.table(spark, sf, "documents")
    name = F.concat_ws("-", "source", F.floor(F.col("doc_id") / LEGACY_SPAN).cast("string"))
    entries = d.groupBy(name.alias("file_id")).agg(F.transform(F.sort_array(F.collect_list("doc_id")), lambda x: x.cast("string")).alias("block_ids"))
    blocks = d.select(F.col("doc_id").cast("string").alias("block_id"), F.octet_length("text").cast("long").alias("raw_size"), F.array().cast("array<string>").alias("transforms"), F.lit(None).cast("binary").alias("recipe"))
    return archive.legacy_spans(entries, blocks).select(F.col("file_id").alias("entry"), F.col("span_idx").cast("long").alias("span_idx"), "block_id", "offset", "size")


TOOLS = ["alpha", "bravo", "charlie", "delta", "gzip"]


def _runs(spark, sf):
    """Run rows made from document sizes by integer rules: status, seconds and sizes by dataset and tool number."""
    d = views.table(spark, sf, "documents").groupBy(F.col("lang").alias("dataset")).agg(F.sum(F.octet_length("text")).cast("long").alias("raw"))
    d = d.withColumn("i", F.row_number().over(Window.orderBy("dataset")))  # a row per language
    t = spark.createDataFrame(list(enumerate(TOOLS, 1)), "j int, tool string")
    m = benchmark.matrix(d, t)
    code = (F.col("i") * 5 + F.col("j")) % 9
    status = F.when(F.col("tool") == "gzip", "ok").when(code == 0, "failed").when(code == 1, "skipped").otherwise("ok")
    m = m.withColumn("status", status)
    ok = F.col("status") == "ok"
    seconds, size = (1 + (F.col("i") * 7 + F.col("j") * 3) % 5).cast("double"), F.floor(F.col("raw") / (F.col("j") + 1)).cast("long")
    return m.select("tool", "dataset", "status", F.when(ok, seconds).alias("seconds"), F.when(ok, size).alias("archive_size"))


def _split(spark, sf):
    r = _runs(spark, sf)
    return r.where("tool <> 'gzip'"), r.where("tool = 'gzip'").drop("tool")


def bench_matrix(spark, sf):
    return _runs(spark, sf)


def bench_aggregate(spark, sf):
    return benchmark.aggregate(_split(spark, sf)[0])


def bench_baseline(spark, sf):
    return benchmark.aggregate_baselines(_split(spark, sf)[1])


def bench_weissman(spark, sf):
    return benchmark.score_runs(*_split(spark, sf)).withColumn("score", F.round("score", 6))


def bench_tool_scores(spark, sf):
    return benchmark.score_tools(*_split(spark, sf)).withColumn("score", F.round("score", 6))


def bench_delta(spark, sf):
    return benchmark.delta(benchmark.aggregate(_runs(spark, sf)), "gzip").select("tool", "archive_size", F.round("delta_percent", 6).alias("delta_percent"))


def bench_gate(spark, sf):
    totals = benchmark.aggregate(_runs(spark, sf))
    out = None
    for tool in TOOLS[:-1]:
        g = benchmark.gate(totals, tool, "gzip", -200.0).select(F.lit(tool).alias("tool"), F.round("win_percent", 6).alias("win_percent"), "verdict")
        out = g if out is None else out.unionByName(g)
    return out


def bench_best_rival(spark, sf):
    return benchmark.best_rival(_runs(spark, sf), "gzip", TOOLS[:-1]).withColumn("win_percent", F.round("win_percent", 6))
