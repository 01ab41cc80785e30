"""Words of letters and digits of whole texts, their hashes, and filters of hashes.

A word is a run of ASCII letters, lower-cased, digits and characters beyond ASCII.  Texts are cut into pieces of about
``PIECE`` bytes between words, so that what a text needs besides itself is a hash of 8 bytes for each word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import HOT_KEYS, materialize

PIECE = 1 << 20
#: Bits of a filter for each hash, and in all at least and at most (16 MB): what is broadcast has this bound.
BITS_EACH, LEAST_BITS, MOST_BITS = 16, 1 << 16, 1 << 27
#: A key with more than 1 / HOT_KEYS of the rows, and more rows than this, is dealt out.
LEAST_HOT = 1000

# Bytes of words stand for themselves, all others are blanks.
_PLAIN = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
_ODD = np.uint64(0x9E3779B97F4A7C15)


def pieces(text: str) -> Iterator[list[bytes]]:
    """The words of a text, piece by piece."""
    raw = text.encode("utf-8", "replace").lower().translate(_PLAIN)
    at = 0
    while at < len(raw):
        end = raw.find(b" ", at + PIECE)
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


def word_hashes(text: str) -> np.ndarray:
    """XXH64 of each word of a text, in order."""
    parts = [np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)) for words in pieces(text)]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def gram_hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of ``n`` words; runs of other lengths have other hashes."""
    size = len(codes) - n + 1
    if size < 1:
        return np.zeros(0, np.uint64)
    h = np.full(size, n, np.uint64)
    for i in range(n):
        h = (h ^ codes[i : i + size]) * _ODD
        h ^= h >> np.uint64(29)
    return h


def filter_bits(hashes: DataFrame) -> np.ndarray:
    """Words of bits of a filter of a DataFrame of one column of hashes: a bounded number of them reach the driver."""
    bits, wanted = LEAST_BITS, BITS_EACH * hashes.count()
    while bits < min(wanted, MOST_BITS):
        bits *= 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            at = np.concatenate([p for p in _places(own, bits)]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(np.left_shift(np.uint64(1), (at & 63).astype(np.uint64)).view(np.int64))], names=["word", "bits"])

    found = hashes.mapInArrow(run, "word bigint, bits bigint").groupBy("word").agg(F.expr("bit_or(bits)").alias("bits")).toPandas()
    words = np.zeros(bits // 64, np.uint64)
    words[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64).view(np.uint64)
    return words


def _places(hashes: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    mask = np.uint64(bits - 1)
    for shift in (0, 21, 37):
        yield (hashes >> np.uint64(shift)) & mask


def may_hold(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether a filter may hold each hash; what it lacks was never put in."""
    found = np.ones(len(hashes), bool)
    for at in _places(hashes, 64 * len(words)):
        found &= (words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    return found


def dealt_join(many: DataFrame, one: DataFrame, on: str, salt: Column) -> DataFrame:
    """Inner join in which no key is too heavy for a task, though ``one`` may have many rows of a key.

    Hot keys have over 1 / ``HOT_KEYS`` of the rows of ``many`` each, so there are fewer than ``HOT_KEYS`` of them.  Their
    rows are dealt into parts by ``salt``, a hash of a row's own values, and ``one``'s rows of them go to every part.
    """
    least = max(LEAST_HOT, many.count() // HOT_KEYS)
    often = many.groupBy(on).agg(F.count("*").alias("_n")).filter(F.col("_n") > least)
    hot = F.broadcast(materialize(often.select(on, F.ceil(F.col("_n") / least).cast("int").alias("_parts")), "hot"))
    dealt = many.join(hot, on, "left").withColumn("_deal", F.coalesce(F.pmod(salt, F.col("_parts")).cast("int"), F.lit(0))).drop("_parts")
    copies = one.join(hot, on, "left").withColumn("_deal", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_parts"), F.lit(1)) - 1))).drop("_parts")
    return dealt.join(copies, [on, "_deal"]).drop("_deal")
