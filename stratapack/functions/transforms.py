"""Reversible transforms over bytes. Each apply returns (payload, recipe), or None where it doesn't apply.

A registered pair may be used on a column through apply_transform / reverse_transform, which verify on
apply that the reverse gives the content back and otherwise leave it as it is.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections import Counter
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Applied = tuple[bytes, bytes] | None

# --- gzip header ----------------------------------------------------------------------------------


def gzip_apply(data: bytes) -> Applied:
    """Time, extra flags and system of a plain gzip header go to the recipe."""
    if len(data) < 10 or data[:4] != b"\x1f\x8b\x08\x00":
        return None
    return data[:4] + bytes(6) + data[10:], b"gzip:" + data[4:10].hex().encode()


def gzip_reverse(data: bytes, recipe: bytes) -> bytes:
    if not recipe.startswith(b"gzip:") or len(recipe) != 17 or len(data) < 10:
        raise ValueError("bad gzip recipe")
    return data[:4] + bytes.fromhex(recipe[5:].decode()) + data[10:]


# --- token dictionary -----------------------------------------------------------------------------

MARK, TOKENS = 0xFF, 16
RUN = re.compile(rb"([A-Za-z0-9_]+)")
#: Every byte that is in no token becomes a space.
WORD_BYTES = bytes(b if RUN.fullmatch(bytes([b])) else 32 for b in range(256))
#: A recipe gives a token's length in two bytes; longer ones stay as they are.
MAX_TOKEN = 65_535


def _chosen(words: bytes) -> list[bytes]:
    """words: the data with spaces for all bytes that are in no token."""
    counts = Counter(words.split())
    saving = {t: c * (len(t) - 2) for t, c in counts.items() if c > 1 and 4 <= len(t) <= MAX_TOKEN and c * (len(t) - 2) > len(t)}
    return sorted(saving, key=lambda t: (-saving[t], -len(t), t))[:TOKENS]


def select_tokens(data: bytes) -> list[bytes]:
    """Up to 16 tokens by saving: runs of 4 to MAX_TOKEN word bytes, more than once, worth more than their length."""
    return _chosen(data.translate(WORD_BYTES))


def dictionary_apply(data: bytes) -> Applied:
    """Chosen tokens become two bytes, a literal mark byte is doubled with a zero."""
    whole = data.replace(b"\xff", b"\xff\x00")  # neither byte is in a token
    words = b" %b " % whole.translate(WORD_BYTES)
    tokens = _chosen(words)
    if not tokens:
        return None
    places = []  # start in whole, which is one byte behind words, and number of the token
    for k, t in enumerate(tokens):
        run, step = b" %b " % t, len(t) + 1  # the next run may begin with the space that ends this one
        at = words.find(run)
        while at >= 0:
            places.append((at, k))
            at = words.find(run, at + step)
    places.sort()
    codes, lengths = [bytes([MARK, k + 1]) for k in range(len(tokens))], [len(t) for t in tokens]
    out, end = [], 0
    for at, k in places:
        out += whole[end:at], codes[k]
        end = at + lengths[k]
    out.append(whole[end:])
    out = b"".join(out)
    if len(out) >= len(data):
        return None
    return out, b"".join([struct.pack("<H", len(t)) + t for t in tokens])


def dictionary_reverse(data: bytes, recipe: bytes) -> bytes:
    tokens, at = [], 0
    while at < len(recipe):
        (n,) = struct.unpack_from("<H", recipe, at)
        tokens.append(recipe[at + 2 : at + 2 + n])
        at += 2 + n
    pieces = data.split(b"\xff")
    out = [pieces[0]]
    for p in pieces[1:]:
        if not p:
            out.append(b"\xff")  # a lone mark stays
        elif p[0] == 0:
            out.append(b"\xff" + p[1:])
        elif p[0] <= len(tokens):
            out.append(tokens[p[0] - 1] + p[1:])
        else:
            out.append(b"\xff" + p)
    return b"".join(out)


# --- byte delta -----------------------------------------------------------------------------------


def delta_apply(data: bytes) -> Applied:
    x = np.frombuffer(data, np.uint8)
    return np.diff(x, prepend=np.uint8(0)).astype(np.uint8).tobytes(), b""


def delta_reverse(data: bytes, recipe: bytes) -> bytes:
    return np.cumsum(np.frombuffer(data, np.uint8), dtype=np.uint8).tobytes()


# --- branch converters ----------------------------------------------------------------------------


def _lanes(data: bytes, kind: str) -> tuple[np.ndarray, bytes]:
    whole = len(data) // 4 * 4
    return np.frombuffer(data[:whole], kind).astype(np.uint64), data[whole:]


def _arm64(data: bytes, sign: int) -> bytes:
    """BL targets (26-bit words) and, within 512 MiB, ADRP pages between relative and absolute.

    Converted pages are written sign-extended from 2^17, so the range check picks the same words in both
    directions.
    """
    x, tail = _lanes(data, "<u4")
    pc = np.arange(len(x), dtype=np.int64)
    call = (x >> np.uint64(26)) == 0x25
    moved = (x.astype(np.int64) + sign * pc) & 0x3FFFFFF
    word = x.astype(np.int64)
    page = (word >> 5 & 0x7FFFF) << 2 | word >> 29 & 3  # 21 bits
    near = (word & 0x9F000000 == 0x90000000) & ((page + 0x20000 & 0x1FFFFF) < 0x40000)
    there = page + sign * (pc >> 10) & 0x3FFFF
    there = (there ^ 0x20000) - 0x20000 & 0x1FFFFF
    adrp = word & 0x9F00001F | (there & 3) << 29 | there >> 2 << 5
    x = np.where(call, 0x94000000 | moved, np.where(near, adrp, word))
    return x.astype("<u4").tobytes() + tail


def _arm(data: bytes, sign: int) -> bytes:
    """BL with the always condition: 24-bit word targets, the pipeline two words ahead."""
    x, tail = _lanes(data, "<u4")
    pc = np.arange(len(x), dtype=np.int64) + 2
    call = (x >> np.uint64(24)) == 0xEB
    moved = (x.astype(np.int64) + sign * pc) & 0xFFFFFF
    x = np.where(call, np.uint64(0xEB000000) | moved.astype(np.uint64), x)
    return x.astype("<u4").tobytes() + tail


def _thumb(data: bytes, sign: int) -> bytes:
    """BL pairs of half-words: 22-bit targets. A pair takes both halves, so pairs are found in order."""
    out = bytearray(data)
    at = 0
    while at + 4 <= len(out):
        if out[at + 1] & 0xF8 == 0xF0 and out[at + 3] & 0xF8 == 0xF8:
            high, low = struct.unpack_from("<HH", out, at)
            target = (high & 0x7FF) << 11 | (low & 0x7FF)
            target = (target + sign * (at + 4) // 2) & 0x3FFFFF
            struct.pack_into("<HH", out, at, 0xF000 | target >> 11, 0xF800 | target & 0x7FF)
            at += 2
        at += 2
    return bytes(out)


CALL = re.compile(rb"[\xe8\xe9]", re.DOTALL)


def _x86(data: bytes, sign: int) -> bytes:
    """CALL and JMP displacements whose top byte is a sign extension, between relative and absolute.

    Displacements are taken modulo 2^25 and written sign-extended, so what is converted is told from
    what isn't the same way in both directions. An instruction is passed over whole, converted or not, so
    that no later one changes the bytes an earlier decision rests on.
    """
    out = bytearray(data)
    at = 0
    while (m := CALL.search(data, at)) and m.start() + 5 <= len(data):
        i = m.start()
        if out[i + 4] in (0x00, 0xFF):
            (value,) = struct.unpack_from("<I", out, i + 1)
            value = (value + sign * (i + 5)) & 0x1FFFFFF
            struct.pack_into("<I", out, i + 1, value & 0xFFFFFF | (0xFF000000 if value & 0x1000000 else 0))
        at = i + 5
    return bytes(out)


def _converter(f) -> tuple[Callable[[bytes], Applied], Callable[[bytes, bytes], bytes]]:
    return (lambda data: (f(data, 1), b"")), (lambda data, recipe: f(data, -1))


# --- PNG ------------------------------------------------------------------------------------------

PNG_MAGIC = b"\x89PNG\r\n\x1a\n"


def png_chunks(data: bytes) -> list[tuple[bytes, bytes, int]]:
    """(type, body, offset) up to IEND; empty if truncated or not a PNG."""
    if not data.startswith(PNG_MAGIC):
        return []
    out, at = [], 8
    while at + 12 <= len(data):
        (n,) = struct.unpack_from(">I", data, at)
        kind = data[at + 4 : at + 8]
        if at + 12 + n > len(data):
            return []
        out.append((kind, data[at + 8 : at + 8 + n], at))
        at += 12 + n
        if kind == b"IEND":
            return out
    return []


def png_apply(data: bytes) -> Applied:
    """Image data inflated, if deflating it again at level 9 or 6 gives the same bytes.

    The recipe keeps the level, the sizes of the data chunks, and all bytes before and after them.
    """
    chunks = png_chunks(data)
    image = [i for i, c in enumerate(chunks) if c[0] == b"IDAT"]
    if not image or image != list(range(image[0], image[-1] + 1)):
        return None
    packed = b"".join([chunks[i][1] for i in image])
    try:
        raw = zlib.decompress(packed)
    except zlib.error:
        return None
    level = next((x for x in (9, 6) if zlib.compress(raw, x) == packed), None)
    if level is None:
        return None
    first, last = chunks[image[0]][2], chunks[image[-1]][2] + 12 + len(chunks[image[-1]][1])
    sizes = [len(chunks[i][1]) for i in image]
    head, tail = data[:first], data[last:]
    recipe = b"png1" + struct.pack(f"<BII{len(sizes)}I", level, len(sizes), len(head), *sizes) + head + tail
    return raw, recipe


def png_reverse(raw: bytes, recipe: bytes) -> bytes:
    if recipe[:4] != b"png1":
        raise ValueError("bad png recipe")
    level, n, head = struct.unpack_from("<BII", recipe, 4)
    sizes = struct.unpack_from(f"<{n}I", recipe, 13)
    at = 13 + 4 * n
    packed, out, p = zlib.compress(raw, level), [recipe[at : at + head]], 0
    for s in sizes:
        body = b"IDAT" + packed[p : p + s]
        out.append(struct.pack(">I", s) + body + struct.pack(">I", zlib.crc32(body)))
        p += s
    return b"".join([*out, recipe[at + head :]])


# --- registry -------------------------------------------------------------------------------------

TRANSFORMS: dict[str, tuple[Callable[[bytes], Applied], Callable[[bytes, bytes], bytes]]] = {
    "gzip": (gzip_apply, gzip_reverse),
    "dictionary": (dictionary_apply, dictionary_reverse),
    "delta": (delta_apply, delta_reverse),
    "branch_x86": _converter(_x86),
    "branch_arm64": _converter(_arm64),
    "branch_arm": _converter(_arm),
    "branch_thumb": _converter(_thumb),
    "png": (png_apply, png_reverse),
}
#: Known by name, but no library for them is here: never candidates that succeed.
UNAVAILABLE = ("jpeg", "png_deflate")


def register_transform(name: str, apply: Callable[[bytes], Applied], reverse: Callable[[bytes, bytes], bytes]) -> None:
    TRANSFORMS[name] = (apply, reverse)


def apply_verified(name: str, data: bytes) -> Applied:
    """Apply, and keep the result only if the reverse gives back exactly the content."""
    pair = TRANSFORMS.get(name)
    if pair is None or not data:
        return None
    got = pair[0](data)
    return got if got is not None and pair[1](*got) == data else None


def reverse(transforms: list[str], payload: bytes, recipe: bytes | None) -> bytes:
    for name in reversed(transforms):
        payload = TRANSFORMS[name][1](payload, recipe or b"")
    return payload


RESULT = "struct<payload: binary, recipe: binary, applied: string>"


def apply_transform(content: Column, name: Column) -> Column:
    """payload, recipe, applied (null where the transform fell back to the content)."""

    @F.pandas_udf(RESULT)
    def run(data: pd.Series, names: pd.Series) -> pd.DataFrame:
        rows = []
        for d, t in zip(data, names, strict=True):
            got = None if d is None else apply_verified(t, bytes(d))
            rows.append((d, None, None) if got is None else (*got, t))
        return pd.DataFrame(rows, columns=["payload", "recipe", "applied"])

    return run(content, name)


def reverse_transform(payload: Column, recipe: Column, applied: Column) -> Column:
    @F.pandas_udf("binary")
    def run(data: pd.Series, recipes: pd.Series, names: pd.Series) -> pd.Series:
        return pd.Series([d if t is None or d is None else reverse([t], bytes(d), r) for d, r, t in zip(data, recipes, names, strict=True)], dtype=object)

    return run(payload, recipe, applied)
