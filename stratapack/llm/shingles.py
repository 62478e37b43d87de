"""Word shingles as sets of 64-bit hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from stratapack.llm.common import ascii_words, mix64, row_bounds


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Each text's sorted distinct k-word shingles, lower-cased over A-Z, words between ASCII white space.

    With fewer than k words the whole sequence is the one shingle; without words the set is empty.
    """
    n = len(texts)
    rows, words, index = ascii_words(pc.ascii_lower(texts))
    of = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words.cast(pa.binary()).to_pylist()), np.uint64, len(words))
    h = of[index] if len(index) else np.zeros(0, np.uint64)
    at = row_bounds(rows, n)
    out = []
    with np.errstate(over="ignore"):
        prime = np.uint64(0x9E3779B97F4A7C15)
        roll = np.full(max(len(h) - k + 1, 0), k, np.uint64)
        for j in range(k):
            roll = mix64(roll * prime + h[j : j + len(roll)])
        for i in range(n):
            a, b = int(at[i]), int(at[i + 1])
            if b - a >= k:
                out.append(np.unique(roll[a : b - k + 1]))
            elif b > a:
                x = np.full(1, b - a, np.uint64)
                for j in range(a, b):
                    x = mix64(x * prime + h[j])
                out.append(x)
            else:
                out.append(np.zeros(0, np.uint64))
    return out
