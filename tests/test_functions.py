"""Transforms, codecs, chunking, packing and scalar helpers on their own."""

import gzip
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratapack.functions import classify, codecs, hashing
from stratapack.functions import transforms as T
from stratapack.operators import benchmark, chunking, packing


def payloads(n=120):
    rng = random.Random(2)
    hot = [0xE8, 0xE9, 0, 255, 1, 0xF0, 0xF8, 0xEB, 0x94, 0x97]
    for _ in range(n):
        yield bytes(rng.choice([*hot, rng.randrange(256)]) for _ in range(rng.choice([0, 1, 3, 5, 50, 1500])))
        yield b" ".join(rng.choice([b"CompressionBackend", b"ab\xff", b"word_1", b"x\xff\x01", b"\xff"]) for _ in range(rng.randrange(60)))


@pytest.mark.parametrize("name", list(T.TRANSFORMS))
def test_reverse_gives_back(name):
    apply, reverse = T.TRANSFORMS[name]
    for d in payloads():
        got = apply(d)
        assert got is None or reverse(*got) == d


def png(raw: bytes, level: int, split: int, tail=b"") -> bytes:
    packed = zlib.compress(raw, level)
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    body = b"".join(chunk(b"IDAT", packed[i : i + split]) for i in range(0, len(packed), split))
    return T.PNG_MAGIC + chunk(b"IHDR", b"\0" * 13) + body + chunk(b"IEND", b"") + tail


def test_png():
    raw = b"abcabcabd" * 500
    for level in (6, 9):
        for tail in (b"", b"after the end"):
            d = png(raw, level, 17, tail)
            payload, recipe = T.apply_verified("png", d)
            assert payload == raw and T.png_reverse(payload, recipe) == d
    assert T.apply_verified("png", png(raw, 1, 1000)) is None
    assert T.png_chunks(png(raw, 9, 17)[:-3]) == []


def test_gzip_and_dictionary():
    d = gzip.compress(b"x" * 50, mtime=12345)
    assert T.gzip_apply(d)[0][4:10] == bytes(6)
    with pytest.raises(ValueError):
        T.gzip_reverse(d, b"nonsense")
    payload, recipe = T.dictionary_apply(b"CompressionBackend CompressionBackend CompressionBackend CompressionBackend")
    assert recipe and len(payload) < 20
    assert T.dictionary_reverse(b"a\xff", b"") == b"a\xff" and T.dictionary_reverse(b"\xff\x05z", b"") == b"\xff\x05z"


def test_codecs():
    d = b"alpha beta gamma " * 500
    for name, (pack, unpack) in codecs.CODECS.items():
        if name != "inflate":
            assert unpack(pack(d)) == d, name
    assert codecs.parse_spec("zstd-3, nothing,zstd-3,bz2") == ["zstd-3", "bz2"] and codecs.parse_spec("") == ["lzma"]
    codecs.register_codec("tie-a", lambda x: x, lambda x: x)
    codecs.register_codec("tie-b", lambda x: x, lambda x: x)
    assert codecs.compete(d, ["tie-a", "tie-b"])[0] == "tie-a"


def brute_cuts(data):
    out, h, start = [], 0, 0
    if len(data) <= 65536:
        return [len(data)]
    for i, b in enumerate(data):
        h = ((h * 33) & 0xFFFFFFFF) ^ b
        n = i + 1 - start
        if n >= 8192 and (n >= 65536 or not h & 0x3FFF):
            out.append(i + 1)
            h, start = 0, i + 1
    return out + [len(data)] * (start < len(data))


def test_chunks():
    rng = random.Random(1)
    for d in [b"", b"x", b"alpha-beta-gamma-delta-" * 6000, bytes(rng.randrange(256) for _ in range(300_000))]:
        assert chunking.cut_points(d) == brute_cuts(d)
        ends = chunking.gear_cut_points(d)
        assert ends[-1] == len(d) and all(b - a <= chunking.MAX_CHUNK for a, b in zip([0, *ends], ends))
    d = bytes(rng.randrange(256) for _ in range(400_000))
    edited = d[:1000] + b"inserted" + d[1000:]
    cut = lambda x: {x[a:b] for a, b in zip([0, *chunking.gear_cut_points(x)], chunking.gear_cut_points(x))}
    assert len(cut(d) & cut(edited)) >= len(cut(d)) // 2


def test_fnv_and_rolling():
    def fnv(d, h):
        for b in d:
            h = (h ^ b) * hashing.FNV_PRIME % (1 << 64)
        return struct.pack("<Q", h).hex()

    items = [b"", b"a", bytes(range(256)) * 20, b"foobar"]
    assert hashing.fnv_lanes(items) == [fnv(d, hashing.FNV_SEED_A) + fnv(d, hashing.FNV_SEED_B) for d in items]


def test_chain():
    h = np.eye(4, dtype=np.float32)
    h[3] = [0.9, 0, 0.1, 0]
    assert packing.chain(h, np.array([1, 9, 1, 1])) == [1, 0, 3, 2]
    assert packing.chain(h[:2], np.array([1, 2])) == [0, 1]


def test_weissman_and_status(spark):
    one = spark.createDataFrame([(80, 2.0, 100, 4.0), (80, 1.0, 100, 4.0), (0, 2.0, 100, 4.0), (None, 2.0, 100, 4.0)], "s long, t double, bs long, bt double")
    got = [r[0] for r in one.select(benchmark.weissman(*map(F.col, ("s", "t", "bs", "bt")))).collect()]
    assert got[0] == pytest.approx(2.5) and got[1:] == [None, None, None]
    runs = spark.createDataFrame([("a", "x", "ok", 1.2, 100), ("b", "x", "failed", None, None), ("c", "x", "ok", 1.0, 5), ("c", "y", "skipped", None, None), ("d", "x", "skipped", None, None)], "tool string, dataset string, status string, seconds double, archive_size long")
    assert {r["tool"]: (r["status"], r["archive_size"]) for r in benchmark.aggregate(runs).collect()} == {"a": ("ok", 100), "b": ("failed", 0), "c": ("partial", 5), "d": ("skipped", 0)}
    assert benchmark.aggregate_baselines(runs.limit(0)).first()["status"] == "ok"
    assert benchmark.gate(benchmark.aggregate(runs), "c", "a", 10.0).first()["verdict"] == "incomplete"
    assert "n/a" in benchmark.render(benchmark.delta(benchmark.aggregate(runs), "a"))


def test_run_tool(tmp_path):
    here = tmp_path / "in"
    here.write_text("x")
    out = str(tmp_path / "out")
    run = lambda *c, d=str(here): benchmark.run_tool(list(c), d, out)[0]
    assert run("true", d="missing") == "skipped" and run("no-such-tool") == "skipped" and run("sh", "-c", "exit 3") == "failed"
    assert run("sh", "-c", "echo BENCHMARK_SKIP: no >&2; exit 85") == "skipped" and run("true") == "failed"
    assert run("sh", "-c", f"echo y > {out}") == "ok"


def test_scalars(spark):
    d = spark.createDataFrame([("noise\nBENCHMARK_SKIP: why", "", 1_500_000)], "e string, o string, n long")
    r = d.select(classify.skip_reason(F.col("e"), F.col("o")).alias("skip"), classify.dictionary_size(F.col("n")).alias("d"), hashing.megabytes(F.col("n")).alias("mb")).first()
    assert (r["skip"], r["d"], r["mb"]) == ("why", 2 << 20, 1.5)


def test_arm64_adrp():
    """ADRP of one page from several places becomes one word within 512 MiB; pages farther off stay."""

    def adrp(page, register=3):
        return 0x90000000 | (page & 3) << 29 | (page >> 2 & 0x7FFFF) << 5 | register

    rng = np.random.default_rng(1)
    n = 6000  # 24 KB: six pages
    words = np.full(n, 0xD503201F, np.uint32)
    places = [0, 1023, 1024, 2500, 5999]
    for page in (0, 5, 0x1FFF0, -0x1F000):
        for at in places:
            words[at] = adrp(page - (at >> 10))
        out, recipe = T.TRANSFORMS["branch_arm64"][0](words.tobytes())
        got = np.frombuffer(out, np.uint32)
        assert {int(got[at]) for at in places} == {adrp(page)}
        assert (np.delete(got, places) == 0xD503201F).all()
        assert T.TRANSFORMS["branch_arm64"][1](out, recipe) == words.tobytes()
    for page in (0x20000, -0x20001, 0xFFFFF):
        words[places] = adrp(page)
        assert T.TRANSFORMS["branch_arm64"][0](words.tobytes())[0] == words.tobytes()
    edge = np.array([adrp(0x1FFFF)] * n, np.uint32).tobytes()  # wraps and comes back
    noise = (rng.integers(0, 1 << 32, n, dtype=np.uint32) & 0x6FFFFFFF | 0x90000000).astype(np.uint32).tobytes()
    for data in (edge, noise, noise[:-3]):
        out, recipe = T.TRANSFORMS["branch_arm64"][0](data)
        assert out != data and T.TRANSFORMS["branch_arm64"][1](out, recipe) == data


def test_long_repeated_token():
    """A repeated token that a recipe's two-byte length can't hold stays as it is."""
    for n in (65_535, 65_536, 200_000):
        data = b"k" * n + b" " + b"k" * n + b" alpha alpha alpha alpha alpha"
        payload, recipe = T.dictionary_apply(data)
        assert T.dictionary_reverse(payload, recipe) == data and (len(payload) < 100) == (n == 65_535)
    assert T.dictionary_apply(b"k" * 70_000 + b" " + b"k" * 70_000) is None


def test_skip_without_note_and_stale_output(spark, tmp_path):
    d = spark.createDataFrame([("BENCHMARK_SKIP:", "BENCHMARK_SKIP: out"), ("", "x\nBENCHMARK_SKIP:  \nBENCHMARK_SKIP: two"), ("none", None)], "e string, o string")
    assert [r[0] for r in d.select(classify.skip_reason(F.col("e"), F.col("o"))).collect()] == [classify.SKIP_NOTE, classify.SKIP_NOTE, None]
    data, old = tmp_path / "in", tmp_path / "old"
    data.write_text("x")
    old.write_text("from an earlier run")
    assert benchmark.run_tool(["true"], str(data), str(old))[0] == "failed" and not old.exists()
    assert benchmark.run_tool(["true"], str(data), str(data))[0] == "ok" and data.exists()
    assert benchmark.run_tool(["sh", "-c", "echo BENCHMARK_SKIP:; exit 85"], str(data), str(old))[3] == classify.SKIP_NOTE
