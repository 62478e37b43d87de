"""Content classification and transform routing as pure column expressions over path and bytes.

Magic tests look at a prefix only; the printable share, which needs every byte, comes last in the
cascade so that Spark's CASE skips it for rows that an earlier branch takes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that decide how content is routed.
RAW_EXTENSIONS = [".aac", ".avi", ".bz2", ".cbr", ".flac", ".gif", ".gz", ".m4a", ".mkv", ".mov", ".mp3", ".mp4", ".rar", ".woff", ".woff2", ".xz", ".zst"]
RAW_MAGICS = ["4F676753", "494433", "47494638", "377ABCAF271C", "526172211A07", "425A68", "FD377A585A00", "28B52FFD"]
CHUNKABLE_EXTENSIONS = [".csv", ".yaml", ".yml", ".svg", ".log"]
DELTA_EXTENSIONS = [".bmp", ".tga", ".raw", ".pcx", ".ppm", ".pgm", ".pbm"]
EXECUTABLE_EXTENSIONS = [".exe", ".dll", ".sys", ".ocx"]
JPEG_EXTENSIONS = [".jpg", ".jpeg", ".jpe"]
STRONGER_EXTENSIONS = [
    ".bmp", ".c", ".cc", ".cpp", ".csv", ".cs", ".css", ".go", ".h", ".hpp", ".html", ".ini", ".java", ".js", ".json", ".jsx", ".kt", ".log", ".md", ".pbm",
    ".pcx", ".pgm", ".ppm", ".py", ".raw", ".rb", ".rs", ".sql", ".svg", ".tga", ".toml", ".txt", ".xml",
]
MACHINES = {0x14C: "x86", 0x8664: "x86", 0xAA64: "arm64", 0x1C0: "arm", 0x1C4: "thumb"}
CHUNK_OVER = 65_536
TEXT_PERCENT = 85
PRINTABLE = bytes([*range(0x20, 0x7F), 10, 13, 9])

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def size(content: Column) -> Column:
    return F.octet_length(content).cast("long")


def prefix_hex(content: Column, n: int) -> Column:
    return F.hex(F.substring(content, 1, n))


def starts_with(content: Column, magic: str) -> Column:
    return prefix_hex(content, len(magic) // 2) == magic


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]*$", 0)


def raw_extension(path: Column) -> Column:
    """The last suffix of the file name with its dot; names that only begin with a dot have none."""
    return F.regexp_extract(basename(path), r"^.+(\.[^.]*)$", 1)


def extension(path: Column) -> Column:
    return ascii_lower(raw_extension(path))


def is_precompressed(content: Column) -> Column:
    head = prefix_hex(content, 12)
    long_enough = size(content) >= 12
    out = long_enough & (head.substr(1, 8) == "52494646") & (head.substr(17, 8) == "57454250")
    out = out | (long_enough & (head.substr(9, 8) == "66747970"))
    for m in RAW_MAGICS:
        out = out | starts_with(content, m)
    return out


def prefers_raw(content: Column, path: Column) -> Column:
    return extension(path).isin(RAW_EXTENSIONS) | is_precompressed(content)


def printable_bytes(content: Column) -> Column:
    """Bytes 0x20-0x7E, line ends and tabs; read as Latin-1 every byte is one character."""
    return F.length(F.regexp_replace(F.decode(content, "ISO-8859-1"), r"[^\x20-\x7e\n\r\t]", "")).cast("long")


def printable_bytes_of_text(text: Column) -> Column:
    """The same for a string: the class is ASCII, so no byte of another character matches."""
    return F.octet_length(F.regexp_replace(text, r"[^\x20-\x7e\n\r\t]", "")).cast("long")


def is_text(printable: Column, n: Column) -> Column:
    return (n > 0) & (F.floor(100 * printable / F.greatest(n, F.lit(1))) >= TEXT_PERCENT)


def is_text_bytes(data: bytes) -> bool:
    """is_text of a content at hand."""
    return bool(data) and 100 * (len(data) - len(data.translate(None, PRINTABLE))) // len(data) >= TEXT_PERCENT


def should_chunk(content: Column, path: Column, text: Column | None = None) -> Column:
    """text: whether it is text, where that is known or supposed; else it is found out."""
    n = size(content)
    text = is_text(printable_bytes(content), n) if text is None else text
    return (n > CHUNK_OVER) & ~prefers_raw(content, path) & (extension(path).isin(CHUNKABLE_EXTENSIONS) | text)


def is_executable(content: Column, path: Column) -> Column:
    return extension(path).isin(EXECUTABLE_EXTENSIONS) | starts_with(content, "4D5A")


def little_endian(content: Column, at: Column | int, n: int) -> Column:
    """An unsigned little-endian integer of n bytes at a zero-based place; null past the end."""
    at = F.lit(at) if isinstance(at, int) else at
    digits = F.hex(F.substring(content, at.cast("int") + 1, F.lit(n)))
    swapped = F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(n))])
    return F.when(at + n <= size(content), F.conv(swapped, 16, 10).cast("long"))


def machine(content: Column) -> Column:
    """The PE machine number, null if there is no such header."""
    at = little_endian(content, 0x3C, 4)
    header = F.when((at >= 0) & (at < size(content) - 5), at)
    good = starts_with(content, "4D5A") & (F.hex(F.substring(content, header.cast("int") + 1, F.lit(4))) == "50450000")
    return F.when(good, little_endian(content, header + 4, 2))


def branch_filter(content: Column) -> Column:
    """One lookup: nested conditions would repeat the header's arithmetic in the generated code."""
    names = F.create_map(*[F.lit(x) for pair in MACHINES.items() for x in pair])
    return F.try_element_at(names, machine(content).cast("int"))


def is_jpeg(content: Column, path: Column) -> Column:
    return starts_with(content, "FFD8FF") | extension(path).isin(JPEG_EXTENSIONS)


def is_png(content: Column) -> Column:
    return starts_with(content, "89504E470D0A1A0A")


def is_plain_gzip(content: Column) -> Column:
    return starts_with(content, "1F8B0800") & (size(content) >= 10)


def is_delta_candidate(path: Column) -> Column:
    return extension(path).isin(DELTA_EXTENSIONS)


def pack_bucket(path: Column) -> Column:
    """Executables pack apart from everything else, by extension alone."""
    return F.when(extension(path).isin(EXECUTABLE_EXTENSIONS), "executable").otherwise("compressible")


def stronger_level(path: Column) -> Column:
    return extension(path).isin(STRONGER_EXTENSIONS)


def dictionary_size(n: Column) -> Column:
    """The next power of two, from 1 MiB to 512 MiB."""
    power = F.ceil(F.log2(F.greatest(n, F.lit(1)).cast("double")))
    return F.least(F.greatest(F.pow(F.lit(2.0), power), F.lit(float(1 << 20))), F.lit(float(512 << 20))).cast("long")


#: Fixed value: the note of a skip mark that has none.
SKIP_NOTE = "Skipped by benchmark wrapper"


def skip_reason(stderr: Column, stdout: Column) -> Column:
    """The note of the first line that begins with the skip mark, of stderr, then of stdout; null if neither has one.

    A mark without a note gives SKIP_NOTE.
    """
    mark = r"(?m)^BENCHMARK_SKIP:(.*)$"

    def find(c: Column) -> Column:
        note = F.trim(F.regexp_extract(c, mark, 1))
        return F.when(F.rlike(c, F.lit(mark)), F.when(note == "", SKIP_NOTE).otherwise(note))

    return F.coalesce(find(stderr), find(stdout))


#: Branches that each level enables besides gzip, chunk and stored, which every level has.
LEVEL_BRANCHES = {
    "fast": {"branch", "delta"},
    "balanced": {"branch", "delta", "png_strip", "jpeg", "dictionary"},
    "max": {"branch", "delta", "png_strip", "jpeg", "dictionary", "png_deflate"},
    "insane": {"branch", "delta", "png_strip", "jpeg", "dictionary", "png_deflate"},
}


def route(content: Column, path: Column, level: str = "balanced", text: Column | None = None) -> Column:
    """The first transform that is a candidate; png, jpeg and dictionary confirm themselves later. text: as in should_chunk."""
    on = LEVEL_BRANCHES[level]
    raw, n = prefers_raw(content, path), size(content)
    branch = F.concat(F.lit("branch_"), branch_filter(content))
    out = F.when(is_plain_gzip(content), "gzip").when(raw, "stored")
    if "png_strip" in on:
        out = out.when(is_png(content), "png")
    if "jpeg" in on:
        out = out.when(is_jpeg(content, path), "jpeg")
    out = out.when(is_executable(content, path) & branch.isNotNull(), branch)
    out = out.when(is_delta_candidate(path), "delta")
    if "dictionary" in on:
        out = out.when(is_text(printable_bytes(content), n) if text is None else text, "dictionary")
    return out.when(should_chunk(content, path, text), "chunk").otherwise("none")
