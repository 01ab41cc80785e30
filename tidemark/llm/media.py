"""Media columns: content-defined chunks of payloads, each stored once.

A payload is a column's bytes, padded with bytes 255 to a positive multiple of ``FRAME``, taken as 8-bit samples.  A
gear hash rolls over it, and a chunk ends where the hash's top bits are zero, between ``LEAST`` and ``MOST`` bytes.  A
chunk's digest names it.  Digests that occur more than once are found by a Spark aggregation; their chunks go to a chunk
table, deduplicated by digest, and all other chunks stay in their payload's container.

A container is one value of bytes, the stored form, whose size and hash are reported from what is read back: 16-bit
version, 64-bit payload size, 32-bit count, then the ordered chunk list (32-bit length whose top bit tells a chunk of
the chunk table, digest), then the bytes of the container's own chunks, all little-endian.  Reading joins the listed
digests with the chunk table, puts the payload together in order, and verifies every digest.

Which digests are shared goes to the writing tasks as a Bloom filter, sized from their count up to a bound.  A false
positive only moves a chunk to the chunk table; what is shared is never missed.  Texts are cut twice, once to find what
is shared and once to write: cutting costs less than to shuffle all payloads.

Defined results: a null text is an empty text, whose payload is one frame of padding; equal texts give equal values;
null ids are kept; very long texts are cut into chunks whole; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import frame_slices, joined_by, materialize, text_or_empty
from .bloom import Bloom, bloom_of

FRAME, PAD = 576, b"\xff"
#: Bytes of a chunk at least and at most, and the bits of the hash that are zero at a cut.
LEAST, MOST, CUT_BITS = 512, 16384, 11
DIGEST = 16
_VERSION, _HEAD, _ENTRY, _SHARED = 2, 14, 4 + DIGEST, 1 << 31


def _gear_table() -> np.ndarray:
    """A 32-bit number for each byte, from its blake2b hash."""
    return np.array([int.from_bytes(hashlib.blake2b(bytes([b]), digest_size=4).digest(), "little") for b in range(256)], np.uint32)


_GEAR = _gear_table()


def payload_of(raw: bytes) -> bytes:
    return raw + PAD * (max(1, -(-len(raw) // FRAME)) * FRAME - len(raw))


def cut_ends(payload: bytes) -> list[int]:
    """Where the chunks of a payload end.

    The gear hash at i is the sum of gear[byte j] << (i - j) over the last 32 bytes; doubling the span five times sums
    it for all i at once.
    """
    h = _GEAR[np.frombuffer(payload, np.uint8)]
    for span in (1, 2, 4, 8, 16):
        h[span:] += h[:-span] << np.uint32(span)
    places = (np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + 1).tolist()
    ends, start = [], 0
    for p in places:
        while p - start > MOST:
            start += MOST
            ends.append(start)
        if p - start >= LEAST:
            ends.append(p)
            start = p
    while len(payload) - start > MOST:
        start += MOST
        ends.append(start)
    if start < len(payload):
        ends.append(len(payload))
    return ends


def chunks_of(payload: bytes) -> list[bytes]:
    ends = cut_ends(payload)
    return [payload[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def digest_of(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=DIGEST).digest()


def stored_form(chunks: list[bytes], digests: list[bytes], shared: list[bool]) -> bytes:
    """The container of a payload of these chunks."""
    head = struct.pack("<HQI", _VERSION, sum(map(len, chunks)), len(chunks))
    listed = [struct.pack("<I", len(c) | (_SHARED if s else 0)) + d for c, d, s in zip(chunks, digests, shared, strict=True)]
    return b"".join([head, *listed, *(c for c, s in zip(chunks, shared, strict=True) if not s)])


def chunk_list(media: bytes) -> list[tuple[int, bytes, bool]]:
    """Length, digest, and whether it is in the chunk table, of each chunk of a container."""
    version, _, n = struct.unpack_from("<HQI", media)
    if version != _VERSION:
        raise ValueError(f"a container of version {version}")
    out = []
    for at in range(_HEAD, _HEAD + n * _ENTRY, _ENTRY):
        (size,) = struct.unpack_from("<I", media, at)
        out.append((size & (_SHARED - 1), media[at + 4 : at + _ENTRY], bool(size & _SHARED)))
    return out


def payload_from(media: bytes, fetched: dict[bytes, bytes]) -> bytes:
    """The payload of a container, from its own chunks and those fetched from the chunk table; all are verified."""
    listed, parts = chunk_list(media), []
    at = _HEAD + len(listed) * _ENTRY
    for size, name, shared in listed:
        part = fetched[name] if shared else media[at : at + size]
        at += 0 if shared else size
        if len(part) != size or digest_of(part) != name:
            raise ValueError(f"chunk {name.hex()} is damaged")
        parts.append(part)
    payload = b"".join(parts)
    if len(payload) != struct.unpack_from("<HQ", media)[1]:
        raise ValueError("a container and its chunk list disagree")
    return payload


def feature_of(payload: bytes, n_chunks: int) -> str:
    """Chunks, mean, standard deviation, zero-crossing rate about the mean, and entropy of the samples."""
    x = np.frombuffer(payload, np.uint8)
    counts = np.bincount(x, minlength=256)
    mean = float((counts * np.arange(256)).sum()) / len(x)
    std = (float((counts * np.arange(256) ** 2).sum()) / len(x) - mean * mean) ** 0.5
    above = x > mean
    crossings = int(np.count_nonzero(above[1:] != above[:-1]))
    p = counts[counts > 0] / len(x)
    return f"chunks={n_chunks};mean={mean:.4f};std={std:.4f};zcr={crossings / len(x):.6f};entropy={float(-(p * np.log2(p)).sum()):.4f}"


def _frames(docs: DataFrame, run, schema: str) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text")).mapInPandas(run, schema)


def shared_digests(docs: DataFrame) -> DataFrame:
    """digest of each chunk that occurs more than once."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frame_slices(frames):
            yield pd.DataFrame({"digest": [digest_of(c) for x in frame["text"] for c in chunks_of(payload_of(x.encode()))]})

    return _frames(docs, run, "digest binary").groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1").select("digest")


def write_media(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Containers (doc_id, key, n_bytes, media, n_shared) and the chunk table (digest, chunk), both written."""
    shared = docs.sparkSession.sparkContext.broadcast(bloom_of(materialize(shared_digests(docs), "digests")))  # a bounded number of bits

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filter_: Bloom = shared.value
        for frame in frame_slices(frames):
            rows, out = [], {}
            for doc_id, text in zip(frame["doc_id"], frame["text"], strict=True):
                raw = text.encode()
                chunks = chunks_of(payload_of(raw))
                digests = [digest_of(c) for c in chunks]
                apart = [d in filter_ for d in digests]
                rows.append((doc_id, hashlib.blake2b(b"".join(digests), digest_size=DIGEST).digest(), len(raw), stored_form(chunks, digests, apart), sum(apart), None))
                out |= {d: c for d, c, s in zip(digests, chunks, apart, strict=True) if s}
            rows += [(None, d, 0, None, 0, c) for d, c in out.items()]
            made = pd.DataFrame(rows, columns=["doc_id", "key", "n_bytes", "media", "n_shared", "chunk"])
            made["doc_id"] = made["doc_id"].astype("Int64")
            yield made

    rows = materialize(_frames(docs, run, "doc_id bigint, key binary, n_bytes bigint, media binary, n_shared bigint, chunk binary"), "media")
    chunks = rows.filter("chunk IS NOT NULL").select(F.col("key").alias("digest"), "chunk").dropDuplicates(["digest"])
    return rows.filter("chunk IS NULL").drop("chunk"), materialize(chunks, "chunks")


_FACTS = "key binary, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def _facts(key: bytes, media: bytes, fetched: dict[bytes, bytes]) -> tuple:
    """What is asked for of a payload that is put together from what was read."""
    payload = payload_from(media, fetched)
    return key, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(payload, len(chunk_list(media)))


def read_media(containers: DataFrame, chunks: DataFrame) -> DataFrame:
    """doc_id, n_bytes and what the payload read back gives, of each container."""
    names = [x.split()[0] for x in _FACTS.split(", ")]

    def complete(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frame_slices(frames):
            yield pd.DataFrame([_facts(k, m, {}) for k, m in zip(frame["key"], frame["media"], strict=True)], columns=names)

    # equal payloads have equal containers and are put together once
    local = containers.filter("n_shared = 0").select("key", "media").mapInPandas(complete, _FACTS).dropDuplicates(["key"])
    apart = containers.filter("n_shared > 0").select("key", "media")

    def listed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frame_slices(frames):
            rows = [(k, d) for k, m in zip(frame["key"], frame["media"], strict=True) for _, d, s in chunk_list(m) if s]
            yield pd.DataFrame([*dict.fromkeys(rows)], columns=["key", "digest"])

    refs = materialize(apart.mapInPandas(listed, "key binary, digest binary").distinct(), "refs")
    # hot chunks are few and at most MOST bytes each; a payload's chunks are as many as its length allows
    found = joined_by(refs, chunks, "digest")
    fetched = found.groupBy("key").agg(F.collect_list(F.struct("digest", "chunk")).alias("fetched"))

    def put_together(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frame_slices(frames, 100):
            yield pd.DataFrame([_facts(k, m, {x["digest"]: x["chunk"] for x in f}) for k, m, f in frame[["key", "media", "fetched"]].itertuples(index=False)], columns=names)

    remote = apart.dropDuplicates(["key"]).join(fetched, "key").mapInPandas(put_together, _FACTS)
    facts = materialize(local.unionByName(remote), "facts")
    return joined_by(containers.select("doc_id", "key", "n_bytes"), facts, "key").select("doc_id", "n_bytes", *names[1:])


def media_columns(docs: DataFrame) -> DataFrame:
    """Store the payloads of all texts, read them back: one row for each document."""
    return read_media(*write_media(docs))
