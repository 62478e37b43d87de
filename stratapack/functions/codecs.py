"""Codec registry: named pairs of compress and decompress over bytes.

A spec lists codecs by name, each with its parameters ("lzma,zstd-19"); unknown names are left out and
an empty result falls back to the first codec. Stamps carry every parameter, so a block can be decoded
from its own stamp. The competition takes the smallest result, the earlier codec on ties. A codec of
STREAMS whose output has already grown to the smallest result so far can't win any more and stops there.
"""

from __future__ import annotations

import bz2
import lzma
import zlib
from collections.abc import Callable

import zstandard

Codec = tuple[Callable[[bytes], bytes], Callable[[bytes], bytes]]

_LZMA = [{"id": lzma.FILTER_LZMA2, "preset": 9 | lzma.PRESET_EXTREME}]
#: The dictionary of that preset, which decoding always allows for.
MAX_DICT = 64 << 20


def _zstd(level: int) -> Codec:
    return (lambda d: zstandard.ZstdCompressor(level=level).compress(d)), (lambda d: zstandard.ZstdDecompressor().decompress(d))


def _lzma_filters(n: int) -> list[dict]:
    """With a dictionary no longer than the data: the same bytes, without clearing tables for 64 MiB each time."""
    return [_LZMA[0] | {"dict_size": min(max(n, 4096), MAX_DICT)}]


def _lzma(d: bytes) -> bytes:
    return lzma.compress(d, lzma.FORMAT_RAW, filters=_lzma_filters(len(d)))


def _unlzma(d: bytes) -> bytes:
    x = lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=_LZMA)
    out = x.decompress(d)
    if not x.eof or x.unused_data:
        raise ValueError("truncated or trailing codec data")
    return out


CODECS: dict[str, Codec] = {
    "lzma": (_lzma, _unlzma),
    "zstd-3": _zstd(3),
    "zstd-19": _zstd(19),
    "bz2": (lambda d: bz2.compress(d, 9), bz2.decompress),
    "zlib-9": (lambda d: zlib.compress(d, 9), zlib.decompress),
    "zlib-6": (lambda d: zlib.compress(d, 6), zlib.decompress),
}
#: For data of a given length, a compressor that is fed piece by piece and ends with the bytes of its codec above.
#: zstd's blocks are cut otherwise when it is fed so, which gives other bytes.
STREAMS: dict[str, Callable] = {
    "lzma": lambda n: lzma.LZMACompressor(lzma.FORMAT_RAW, filters=_lzma_filters(n)),
    "bz2": lambda n: bz2.BZ2Compressor(9),
    "zlib-9": lambda n: zlib.compressobj(9),
    "zlib-6": lambda n: zlib.compressobj(6),
}
#: Bytes that a compressor is fed before its output is measured again.
PIECE = 128 << 10
#: Known by name, but their libraries are not here.
UNAVAILABLE = ("zpaq", "ppmd", "cm", "brotli")

#: level -> (codec spec, verify every block after writing)
LEVELS = {"fast": ("zstd-3", False), "balanced": ("lzma,zstd-19", False), "max": ("lzma,zstd-19,bz2", False), "insane": ("lzma,zstd-19,bz2,zlib-9", True)}
STRONG, LIGHT = "lzma", "zstd-3"
#: In a spec: the strong or the light codec, by the extension of a group's first file.
SELECTIVE = "selective"


def register_codec(name: str, compress: Callable[[bytes], bytes], decompress: Callable[[bytes], bytes]) -> None:
    CODECS[name] = (compress, decompress)
    STREAMS.pop(name, None)


def parse_spec(spec: str) -> list[str]:
    names = [n.strip() for n in spec.split(",")]
    return [n for n in dict.fromkeys(names) if n in CODECS or n == SELECTIVE] or ["lzma"]


def choose(spec: list[str], strong: bool) -> list[str]:
    """The spec with its selective entry, if any, decided for one group."""
    return list(dict.fromkeys((STRONG if strong else LIGHT) if n == SELECTIVE else n for n in spec))


def codec(name: str) -> Codec:
    if name not in CODECS:
        raise ValueError(f"unsupported codec: {name}")
    return CODECS[name]


def compress_below(name: str, data: bytes, limit: int) -> bytes | None:
    """The result of a codec if it is shorter than the limit; one that gets there is given up, whatever is left to read."""
    if name not in STREAMS:
        out = CODECS[name][0](data)
        return out if len(out) < limit else None
    stream, parts, n = STREAMS[name](len(data)), [], 0
    view = memoryview(data)
    for at in range(0, len(data), PIECE):
        parts.append(stream.compress(view[at : at + PIECE]))
        n += len(parts[-1])
        if n >= limit:
            return None
    parts.append(stream.flush())
    return b"".join(parts) if n + len(parts[-1]) < limit else None


def compete(data: bytes, spec: list[str]) -> tuple[str, bytes]:
    """The smallest result and its codec; the earlier in the list on ties.

    Codecs that can stop run after those that can't, the dearest of them last, when the smallest result to stop at is
    known; which wins doesn't depend on that.
    """
    first, *others = sorted(spec, key=lambda n: (n in STREAMS, n == STRONG))
    best = (first, CODECS[first][0](data))
    for name in others:
        out = compress_below(name, data, len(best[1]) + (spec.index(name) < spec.index(best[0])))
        if out is not None:
            best = (name, out)
    return best
