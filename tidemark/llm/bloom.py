"""Bloom filters of keys, sized from a count of them, for work that a later join decides."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a filter for each key, and in all at least and at most (16 MB): what is broadcast has this bound.
BITS_EACH, LEAST_BITS, MOST_BITS = 16, 1 << 16, 1 << 27
HASHES = 4


class Bloom:
    """Keys are strings or bytes; what the filter lacks was never put in."""

    def __init__(self, words: np.ndarray):
        self.words, self.bits = words, 64 * len(words)

    def __contains__(self, key: bytes | str) -> bool:
        words = self.words
        return all(int(words[p >> 6]) >> (p & 63) & 1 for p in places(key, self.bits))


def places(key: bytes | str, bits: int) -> list[int]:
    raw = key.encode() if isinstance(key, str) else key
    a, b = zlib.crc32(raw), zlib.crc32(raw, 0x5BD1E995) | 1
    return [(a + i * b) % bits for i in range(HASHES)]


def bloom_of(keys: DataFrame) -> Bloom:
    """The filter of a DataFrame of one column: its words of bits, a bounded number, reach the driver."""
    bits = LEAST_BITS
    wanted = BITS_EACH * keys.count()
    while bits < min(wanted, MOST_BITS):
        bits *= 2

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            at = np.array([p for k in frame.iloc[:, 0] for p in places(k, bits)], np.int64)
            yield pd.DataFrame({"word": at // 64, "bits": np.left_shift(np.uint64(1), (at % 64).astype(np.uint64)).view(np.int64)})

    found = keys.mapInPandas(run, "word bigint, bits bigint").groupBy("word").agg(F.expr("bit_or(bits)").alias("bits")).toPandas()
    words = np.zeros(bits // 64, np.uint64)
    words[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64).view(np.uint64)
    return Bloom(words)
