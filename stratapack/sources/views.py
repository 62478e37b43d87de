"""File views over the driver's tables: file_id, path, kind, content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Documents of one source with ids in one span of this length make one bundle, so bundles stay bounded.
BUNDLE_SPAN = 1000

# Literal probe rows: name, bytes as hex, for the routing matrix.
_PE = lambda machine: "4D5A" + "00" * 58 + "40000000" + "50450000" + machine + "0000"
PROBES = [
    ("clip.mp4", "000000186674797069736F6D"),
    ("notes.txt", b"alpha alpha alpha alpha alpha\n".hex()),
    ("image.png", "89504E470D0A1A0A0000000D49484452"),
    ("image.jpg", "FFD8FFE000104A464946"),
    ("bundle.zip", "504B03041400000008000000"),
    ("small.gz", "1F8B080010203040" + "0203AABB"),
    ("flagged.gz", "1F8B080810203040" + "0203AABB"),
    ("photo.JPEG", "0011"),
    ("anim.dat", "474946383961"),
    ("pack.bin", "377ABCAF271C0004"),
    ("web.img", "52494646000000005745425056503820"),
    ("short.img", "5249464600000000574542"),
    ("tool.exe", _PE("4C01")),
    ("tool64.bin", _PE("6486")),
    ("arm64.dll", _PE("64AA")),
    ("arm.dll", _PE("C001")),
    ("thumb.sys", _PE("C401")),
    ("odd.exe", _PE("FFFF")),
    ("broken.exe", "4D5A"),
    ("scan.BMP", "424D0102"),
    ("empty.txt", ""),
    ("two.bin", "0102"),
    (".bashrc", b"export A=1\n".hex()),
    ("noext", b"plain text here".hex()),
    ("archive.tar.xz", "FD377A585A00"),
    ("dir.d/file", "00FF00FF"),
]


def _files(df: DataFrame) -> DataFrame:
    return df.select("file_id", "path", F.lit("file").alias("kind"), "content")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    path = F.concat(F.lit("documents/"), "lang", F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return _files(d.select(F.col("doc_id").alias("file_id"), path.alias("path"), F.encode("text", "UTF-8").alias("content")))


def bundle_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of one source and id span joined by line ends in id order."""
    d = table(spark, sf_dir, "documents").withColumn("span", F.floor(F.col("doc_id") / BUNDLE_SPAN).cast("long"))
    g = d.groupBy("source", "span").agg(F.sort_array(F.collect_list(F.struct("doc_id", "text"))).alias("docs"))
    text = F.array_join(F.transform("docs", lambda x: x["text"]), "\n")
    path = F.concat(F.lit("bundles/"), "source", F.lit("-"), F.col("span").cast("string"), F.lit(".txt"))
    return _files(g.select(F.element_at("docs", 1)["doc_id"].alias("file_id"), path.alias("path"), F.encode(text, "UTF-8").alias("content")))


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    path = F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".html"))
    return _files(p.select(F.col("page_id").alias("file_id"), path.alias("path"), F.encode("html", "UTF-8").alias("content")))


def conv_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    g = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(": "), t["text"])), "\n")
    path = F.concat(F.lit("conversations/"), F.col("conv_id").cast("string"), F.lit(".md"))
    return _files(g.select(F.col("conv_id").alias("file_id"), path.alias("path"), F.encode(text, "UTF-8").alias("content")))


def vec_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One float32 vector per file, as little-endian bytes."""
    import numpy as np

    @F.pandas_udf("binary", F.PandasUDFType.SCALAR)
    def raw(v):
        return v.map(lambda x: np.asarray(x, "<f4").tobytes())

    e = table(spark, sf_dir, "embeddings")
    path = F.concat(F.lit("vectors/"), F.col("label").cast("string"), F.lit("/"), F.col("vec_id").cast("string"), F.lit(".raw"))
    return _files(e.select(F.col("vec_id").alias("file_id"), path.alias("path"), raw("embedding").alias("content")))


def probe_files(spark: SparkSession) -> DataFrame:
    rows = [(i, name, h) for i, (name, h) in enumerate(PROBES)]
    d = spark.createDataFrame(rows, "file_id long, path string, h string")
    return _files(d.select("file_id", "path", F.unhex("h").alias("content")))


def all_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and pages as one tree; ids are made unique by the view's number."""
    views = [doc_files(spark, sf_dir), page_files(spark, sf_dir)]
    out = None
    for i, v in enumerate(views):
        v = v.withColumn("file_id", F.col("file_id") * len(views) + i)
        out = v if out is None else out.unionByName(v)
    return out
