"""What keeps an archive of large tables cheap: little scratch, even tasks, blocks decoded where their spans are."""

import lzma
import os
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stratapack import session
from stratapack.functions import classify, codecs, transforms
from stratapack.operators import archive, packing
from stratapack.operators.archive import Options


def texts(n, size):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(3000)]
    return [(f"t/{i}.txt", " ".join(rng.choices(words, k=size // 7)).encode()) for i in range(n)]


def frame(spark, files):
    return spark.createDataFrame([(i, p, "file", bytearray(c)) for i, (p, c) in enumerate(files)], "file_id long, path string, kind string, content binary")


@pytest.fixture
def scratch(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_dir", lambda s: str(tmp_path))
    return tmp_path


def test_scratch_holds_no_payload_twice(spark, scratch):
    files = texts(40, 50_000)
    files += [(f"c/{i}.txt", files[0][1]) for i in range(10)]
    a = archive.build(spark, frame(spark, files), Options(spec="zstd-3"))
    left = sum(os.path.getsize(os.path.join(d, x)) for d, _, names in os.walk(scratch) for x in names)
    assert left < 0.7 * sum(len(c) for _, c in files)  # the encoded groups, not the payloads and their originals
    assert {r["path"]: bytes(r["content"]) for r in archive.restore(a).where("ok").collect()} == dict(files)


def test_a_task_for_each_group(spark, scratch, monkeypatch):
    monkeypatch.setattr(archive, "GROUP_CAPS", {"compressible": 60_000, "executable": 60_000})
    monkeypatch.setattr(archive, "TASK_BYTES", 1000)
    a = archive.build(spark, frame(spark, texts(24, 50_000)), Options("fast"))
    parts = [x for d, _, names in os.walk(scratch) for x in names if d.endswith("/groups") and x.endswith(".parquet")]
    assert a.blocks.count() == 24 and len(parts) == 24


def test_many_spans_of_one_block(spark, scratch, monkeypatch):
    monkeypatch.setattr(archive, "SPANS", 3)
    files = texts(20, 3000)
    a = archive.build(spark, frame(spark, files), Options("balanced"))
    assert a.blocks.count() == 1 and archive._spans_by_block(a.spans).count() > 3
    assert {r["path"]: bytes(r["content"]) for r in archive.restore(a).where("ok").collect()} == dict(files)
    lost = archive.Archive(a.entries, a.spans.withColumn("block_id", F.when(F.col("file_id") == 4, "none").otherwise(F.col("block_id"))), a.blocks, a.codecs)
    assert [r["file_id"] for r in archive.verify(lost).where("NOT ok").collect()] == [4]


def test_group_stored_raw_gets_originals(spark, scratch):
    text = b"abcdef abcdef"  # the dictionary makes 5 bytes of it, which zlib makes 13
    a = archive.build(spark, frame(spark, [("a.txt", text)]), Options(spec="zlib-9"))
    assert [(r["codec"], bytes(r["data"])) for r in a.blocks.collect()] == [("stored", text)]
    assert [(r["size"], r["transforms"], r["recipe"]) for r in a.spans.collect()] == [(len(text), [], None)]
    assert [bytes(r["content"]) for r in archive.restore(a).where("ok").collect()] == [text]


@pytest.mark.parametrize("size", [0, 1, 5000, 200_000, 1_500_000])
def test_lzma_gives_the_bytes_of_its_preset(size):
    data = (b" ".join(c for _, c in texts(40, 50_000)))[:size]
    got = codecs.CODECS["lzma"][0](data)
    assert got == lzma.compress(data, lzma.FORMAT_RAW, filters=codecs._LZMA) and codecs.CODECS["lzma"][1](got) == data


@pytest.mark.parametrize("size", [0, 1, 5000, codecs.PIECE, 1_500_000])
def test_codecs_fed_in_pieces_give_the_same_bytes(size):
    data = (b" ".join(c for _, c in texts(40, 50_000)))[:size]
    for name in codecs.STREAMS:
        whole = codecs.CODECS[name][0](data)
        assert codecs.compress_below(name, data, len(whole) + 1) == whole and codecs.compress_below(name, data, len(whole)) is None
    for spec in (["lzma", "zstd-19", "bz2", "zlib-9"], ["zlib-9", "bz2", "zstd-19", "lzma"]):
        every = [(len(codecs.CODECS[n][0](data)), i, n) for i, n in enumerate(spec)]
        assert codecs.compete(data, spec) == (min(every)[2], codecs.CODECS[min(every)[2]][0](data))


def test_a_codec_that_cannot_win_stops(monkeypatch):
    fed = []

    class Plain:
        def compress(self, piece):
            fed.append(len(piece))
            return bytes(piece)

        def flush(self):
            return b""

    monkeypatch.setitem(codecs.CODECS, "plain", (bytes, bytes))
    monkeypatch.setitem(codecs.STREAMS, "plain", lambda n: Plain())
    data = b" ".join(c for _, c in texts(40, 50_000))
    name, out = codecs.compete(data, ["bz2", "plain"])
    assert name == "bz2" and len(out) <= sum(fed) < len(out) + codecs.PIECE < len(data)


def test_the_dearest_codec_has_the_smallest_result_to_stop_at(monkeypatch):
    fed = []

    class Feeds:
        def __init__(self, n):
            self.stream, self.flush = lzma_stream(n), lambda: self.stream.flush()

        def compress(self, piece):
            fed.append(len(piece))
            return self.stream.compress(piece)

    lzma_stream = codecs.STREAMS["lzma"]
    monkeypatch.setitem(codecs.STREAMS, "lzma", Feeds)
    rng = random.Random(5)
    plain, noise = b" ".join(c for _, c in texts(40, 50_000)), rng.randbytes(300_000)
    small = len(codecs.CODECS["bz2"][0](plain))
    assert small < len(codecs.CODECS["lzma"][0](plain))
    assert codecs.compete(plain, ["lzma", "zstd-19", "bz2"]) == ("bz2", codecs.CODECS["bz2"][0](plain))
    assert 0 < sum(fed) < len(plain)
    assert codecs.compete(noise, ["lzma", "zstd-19", "bz2"])[0] == min((len(codecs.CODECS[n][0](noise)), i, n) for i, n in enumerate(["lzma", "zstd-19", "bz2"]))[2]


@pytest.mark.parametrize("spec", [["lzma", "early", "late"], ["early", "lzma", "late"], ["early", "late", "lzma"]])
def test_ties_go_to_the_earlier_codec_whatever_runs_first(spec, monkeypatch):
    data = b" ".join(c for _, c in texts(4, 50_000))
    got = codecs.CODECS["lzma"][0](data)
    for name in ("early", "late"):
        monkeypatch.setitem(codecs.CODECS, name, (lambda d: bytes(len(got)), bytes))
    assert codecs.compete(data, spec)[0] == spec[0] and len(codecs.compete(data, spec)[1]) == len(got)


def test_contents_are_read_twice_only(spark, scratch):
    read = spark.sparkContext.accumulator(0)

    def rows(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    files = frame(spark, texts(20, 3000))
    a = archive.build(spark, files.mapInArrow(rows, files.schema), Options("fast"))  # once to hash them, once to cut and pack them
    assert read.value == 2 * 20 and a.entries.count() == 20


def test_dictionary_codes_whole_runs_only():
    rng = random.Random(7)
    for _ in range(300):
        data = b" ".join(rng.choices([b"aaaa", b"aaaaaaaa", b"aaaa_", b"bbbbb", b"\xff", b"\xffaaaa", b"bbbbb-aaaa", b"x", "é".encode()], k=rng.randrange(60)))
        code = {t: bytes([transforms.MARK, i + 1]) for i, t in enumerate(transforms.select_tokens(data))}
        parts = transforms.RUN.split(data.replace(b"\xff", b"\xff\x00"))
        plain, got = b"".join(map(code.get, parts, parts)), transforms.dictionary_apply(data)
        assert got is None and (not code or len(plain) >= len(data)) or got[0] == plain and transforms.dictionary_reverse(*got) == data


def test_chain_and_sparse_histograms():
    data = [c for _, c in texts(60, 2000)] + [b"", os.urandom(200_000)]
    sizes = np.array([len(d) for d in data])
    h = packing.dense(pd.Series([packing.sparse_histogram(d) for d in data]))
    assert np.array_equal(h, np.stack(packing.fingerprint.func(pd.Series(data)).to_numpy()))
    order = packing.chain(h, sizes)
    assert sorted(order) == list(range(len(data))) and order[0] == int(np.argmax(sizes))
    for i, at in enumerate(order[:-1]):
        assert h[order[i + 1]] @ h[at] >= max(h[j] @ h[at] for j in order[i + 1 :]) - 1e-6


def test_text_by_bytes(spark):
    data = [b"", b"plain text\n", b"\xff" * 3 + b"x" * 17, b"\xff" * 4 + b"x" * 17, bytes(range(256)), "Grüße 中文 text".encode()]
    c = F.col("c")
    rows = spark.createDataFrame([(bytearray(d),) for d in data], "c binary").select("c", classify.is_text(classify.printable_bytes(c), classify.size(c)).alias("t")).collect()
    assert [classify.is_text_bytes(bytes(r["c"])) for r in rows] == [r["t"] for r in rows]
