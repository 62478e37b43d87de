"""Archive round trips, integrity and failure cases."""

import random

import pytest
from pyspark.sql import functions as F

from stratapack.functions import classify, codecs
from stratapack.operators import archive
from stratapack.operators.archive import Options
from stratapack.operators.dedup import resolve_copies
from stratapack.sources import sinks
from stratapack.sources.tree import TreeSource


def frame(spark, files):
    rows = [(i, p, k, None if c is None else bytearray(c)) for i, (p, k, c) in enumerate(files)]
    return spark.createDataFrame(rows, "file_id long, path string, kind string, content binary")


def tree():
    rng = random.Random(3)
    lines = b"".join(b"line %d with a shared prefix and a body\n" % rng.randrange(500) for _ in range(4000))
    return [
        (".", "directory", None), ("a.txt", "file", b"alpha"), ("nested", "directory", None), ("nested/b.txt", "file", b"beta beta beta"), ("empty", "directory", None), ("empty.txt", "file", b""),
        ("copy1.txt", "file", lines), ("copy2.txt", "file", lines), ("big.log", "file", lines + b"tail"), ("code.py", "file", b"CompressionBackend " * 40), ("blob.bin", "file", bytes(range(256)) * 300),
        ("x.raw", "file", bytes(range(256)) * 8), ("clip.mp4", "file", bytes.fromhex("000000186674797069736F6D") * 20), ("t.gz", "file", bytes.fromhex("1F8B0800102030400203AABB") + b"z" * 500), ("ff.txt", "file", b"word_a \xff word_a " * 30),
    ]


@pytest.mark.parametrize("options", [Options("fast"), Options("insane", gear_chunks=True), Options("fast", scope="chunk")])
def test_round_trip(spark, options):
    files = frame(spark, tree())
    a = archive.build(spark, files, options)
    assert archive.structural_faults(a).count() == 0
    got = {r["path"]: r for r in archive.restore(a).collect()}
    for p, k, c in tree():
        assert got[p]["ok"] and got[p]["kind"] == k
        assert k == "directory" or bytes(got[p]["content"]) == c
    spans = {p: [(s["block_id"], s["offset"], s["size"]) for s in g] for p, g in a.entries.join(a.spans.groupBy(F.col("file_id").alias("same_as")).agg(F.sort_array(F.collect_list(F.struct("span_idx", "block_id", "offset", "size"))).alias("g")), "same_as").select("path", "g").collect()}
    assert spans["copy1.txt"] == spans["copy2.txt"]
    if options.level == "fast" and options.spec is None and options.scope == "file":
        assert len(spans["copy1.txt"]) > 1 and len(set(spans["copy1.txt"]) & set(spans["big.log"])) >= 1
    blocks = a.blocks.drop("data").orderBy("payload_offset").collect()
    at = 0
    for b in blocks:
        assert b["payload_offset"] == at
        at += b["encoded_size"]
    stored = [r["codec"] for r in blocks]
    assert "stored" in stored and len(set(stored)) > 1


def test_distinct_small_files_share_a_block(spark):
    a = archive.build(spark, frame(spark, [("a.txt", "file", b"one text here, nothing more to say"), ("b.txt", "file", b"another text there, nothing less to say")]), Options("fast"))
    assert a.blocks.count() == 1 and a.spans.count() == 2


def test_expanding_codec_falls_back(spark):
    codecs.register_codec("inflate", lambda d: d + d + b"x", lambda d: d[: len(d) // 2])
    a = archive.build(spark, frame(spark, [("a.txt", "file", b"repeat me repeat me repeat me repeat me ")]), Options(spec="zlib-9"))
    assert [r["storage"] for r in a.blocks.collect()] == ["compressed"]
    with pytest.raises(ValueError, match="unsupported codec"):
        codecs.codec("unknown")


def test_write_read_tamper(spark, tmp_path):
    a = archive.build(spark, frame(spark, tree()), Options())
    path = str(tmp_path / "out")
    archive.write(spark, a, path, "2020-01-01T00:00:00Z")
    b = archive.read_manifest(spark, path)
    assert archive.verify(b).where("NOT ok").count() == 0
    with pytest.raises(FileExistsError):
        archive.write(spark, a, path)
    assert [p.name for p in tmp_path.iterdir()] == ["out"]
    worst = b.blocks.orderBy(F.desc("raw_size")).first()["block_id"]
    flipped = F.when(F.col("block_id") == worst, F.concat(F.unhex(F.lit("00")), F.expr("substring(data, 2)"))).otherwise(F.col("data"))
    bad = archive.Archive(b.entries, b.spans, b.blocks.withColumn("data", flipped), b.codecs)
    lost = {r["path"] for r in archive.verify(bad).where("NOT ok").collect()}
    owners = b.spans.where(F.col("block_id") == worst).select(F.col("file_id").alias("same_as")).distinct()
    want = {r["path"] for r in b.entries.join(owners, "same_as").collect()}
    assert lost == want and lost
    gone = archive.Archive(b.entries, b.spans, b.blocks.where(F.col("block_id") != worst), b.codecs)
    assert {r["fault"] for r in archive.structural_faults(gone).collect()} == {"missing block"}
    twice = archive.Archive(b.entries, b.spans, b.blocks.unionByName(b.blocks.limit(1)), b.codecs)
    assert {r["fault"] for r in archive.structural_faults(twice).collect()} == {"duplicate block"}
    b.entries.withColumn("size", F.col("size") + 1).write.parquet(str(tmp_path / "e"))
    (tmp_path / "out" / "entries").rename(tmp_path / "old")
    (tmp_path / "e").rename(tmp_path / "out" / "entries")
    with pytest.raises(ValueError, match="manifest checksum"):
        archive.read_manifest(spark, path)
    with pytest.raises(Exception):  # noqa: B017, PT011
        archive.read_manifest(spark, str(tmp_path / "none"))


def test_tree_source_and_extract(spark, tmp_path):
    root = tmp_path / "src"
    (root / "sub" / "deep").mkdir(parents=True)
    (root / "void").mkdir()
    (root / "b.txt").write_bytes(b"bee")
    (root / ".hidden").write_bytes(b"h")
    (root / "sub" / "Alpha.txt").write_bytes(b"alpha" * 100)
    (root / "link").symlink_to(root / "b.txt")
    spark.dataSource.register(TreeSource)
    got = spark.read.format("file_tree").load(str(root))
    kinds = {r["path"]: r["kind"] for r in got.collect()}
    assert kinds == {".": "directory", "b.txt": "file", ".hidden": "file", "sub": "directory", "sub/Alpha.txt": "file", "sub/deep": "directory", "void": "directory", "link": "skipped"}
    assert ".hidden" not in {r["path"] for r in spark.read.format("file_tree").option("includeHidden", "false").load(str(root)).collect()}
    one = spark.read.format("file_tree").load(str(root / "b.txt")).collect()
    assert [(r["path"], bytes(r["content"])) for r in one] == [("b.txt", b"bee")]
    with pytest.raises(Exception, match="deeper than"):
        spark.read.format("file_tree").option("maxDepth", "1").load(str(root)).count()
    files = got.where("kind <> 'skipped'").drop("reason", "size").withColumn("file_id", F.xxhash64("path"))
    a = archive.build(spark, files)
    assert sinks.extract_to(archive.restore(a), str(tmp_path / "dst")) == 7
    for p, k in kinds.items():
        if k == "file":
            assert (tmp_path / "dst" / p).read_bytes() == (root / p).read_bytes()
            assert (tmp_path / "dst" / p).stat().st_mtime_ns == (root / p).stat().st_mtime_ns
        elif k == "directory":
            assert (tmp_path / "dst" / p).is_dir()
    assert [r["path"] for r in archive.entry_list(spark, a).orderBy("position").collect()] == [".", ".hidden", "b.txt", "sub", "sub/Alpha.txt", "sub/deep", "void"]


def test_paths_and_names(spark, tmp_path):
    bad = spark.createDataFrame([("../x", "file", b"1"), ("ok", "file", b"2")], "path string, kind string, content binary")
    with pytest.raises(ValueError, match="leaves the destination"):
        sinks.extract_to(bad, str(tmp_path / "d"))
    assert not (tmp_path / "d").exists()
    (tmp_path / "photos.arc").write_bytes(b"")
    assert sinks.free_name(str(tmp_path), "photos.arc").endswith("photos (2).arc")
    with pytest.raises(RuntimeError), sinks.AtomicFile(str(tmp_path / "x")) as f:
        f.write(b"1")
        raise RuntimeError
    assert [p.name for p in tmp_path.iterdir()] == ["photos.arc"]


def test_selective_codec(spark):
    files = [("a.dll", "file", b"code " * 400), ("b.txt", "file", b"text " * 400)]
    a = archive.build(spark, frame(spark, files), Options(spec=codecs.SELECTIVE))
    where = a.spans.join(a.blocks.select("block_id", "codec"), "block_id").join(a.entries.select("file_id", "path"), "file_id")
    strong = {p: ("." + p.rsplit(".", 1)[1]) in classify.STRONGER_EXTENSIONS for p, _, _ in files}
    assert {r["path"]: r["codec"] == codecs.STRONG for r in where.collect()} == strong
    assert all(r["ok"] for r in archive.verify(a).collect())


def test_size_caps_and_block_ranges(spark, tmp_path):
    a = archive.build(spark, frame(spark, tree()), Options("fast"))
    out = str(tmp_path / "x.pack")
    archive.write(spark, a, out)
    for caps in ({"max_manifest": 10}, {"max_payload": 10}):
        with pytest.raises(ValueError, match="too large"):
            archive.read_manifest(spark, out, **caps)
    got = archive.read_manifest(spark, out, max_manifest=1 << 28, max_payload=2 << 30)
    assert archive.structural_faults(got).count() == 0
    for at in (F.lit(-1), F.col("payload_offset") + (1 << 40)):
        moved = got.blocks.withColumn("payload_offset", F.when(F.col("group_seq") == 0, at).otherwise(F.col("payload_offset")))
        faults = archive.structural_faults(archive.Archive(got.entries, got.spans, moved, got.codecs)).collect()
        assert [r["fault"] for r in faults] == ["block out of range"]


def test_unresolved_span_is_refused(spark):
    spans = spark.createDataFrame([(1, "k"), (2, "lost")], "file_id long, block_key string")
    canonical = spark.createDataFrame([("k", "b")], "block_key string, block_id string")
    with pytest.raises(Exception, match="unresolved span of file 2"):
        resolve_copies(spans, canonical).collect()
