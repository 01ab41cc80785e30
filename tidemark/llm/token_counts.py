"""Token counts from distinct pre-tokens, without ids.

Per-document pre-token frequencies are written as a table of blocks of documents: a block has its documents, its distinct
pre-tokens in buckets, and for each of these the documents that hold it and how often.  A shuffle by bucket brings the
same pre-tokens of all blocks together, where each distinct one is counted once, and its count goes to all places that it
has in blocks.  The counts meet the frequencies in the order of blocks, and pieces times frequency is summed by document.

There are ``SUB`` buckets for each shuffle partition, and a task holds the pre-tokens of one bucket at a time, ``KEEP`` of
them at most: one that comes again after that is counted again.  A row of the shuffle is what a part of a block has for a
bucket, so there are never more rows than pre-tokens in blocks.  A frequent pre-token is there once for each block, so it
makes no bucket heavy: a block has thousands of pre-tokens.

No row is larger than ``PART`` and a pre-token, and tasks stream rows: what one holds does not grow with the rows that it gets.

Defined results: a null text is an empty text of no bytes and no tokens; equal rows give equal rows; null ids are kept;
very long texts are counted whole; an empty table gives an empty result; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import materialize, partitions, slices
from .bpe import PRE_TOKEN

#: Characters and documents of a block; a document's place in it is a 16-bit number.
BLOCK_CHARS, BLOCK_DOCS = 1 << 24, (1 << 15) - 1
#: Characters of pre-tokens, and documents that hold them, of a part of a block.  A part is a row, and many are in memory where tables are written and read.
PART = 1 << 18
#: Bits of a row's ``block`` that tell the parts of a block apart.
PART_BITS = 16
#: Pre-tokens that are counted at a time, and those whose counts a task keeps.
STEP, KEEP = 1 << 15, 1 << 19
#: Bytes of a row group of the table of blocks.
GROUP_BYTES = 1 << 23
#: Buckets of pre-tokens for each shuffle partition.
SUB = 16

#: block: which block, and in the last bits which part of it.  ids, n_bytes: of the block's documents, in its first part.
#: buckets, cuts: the buckets that the part has pre-tokens for, and where in tokens they begin and the last ends.
#: holders and docs, freqs: how many documents hold each pre-token, then which they are and how often, pre-token by pre-token; packed.
_BLOCK = "block bigint, ids array<bigint>, n_bytes array<bigint>, buckets array<int>, cuts array<int>, tokens array<string>, holders binary, docs binary, freqs binary"


class _Cutter:
    def __init__(self, added: list[str]):
        import regex

        self.added, self.cut = added, regex.compile(PRE_TOKEN)
        self.special = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True))) or r"(?!)")

    def __call__(self, text: str) -> list[str]:
        if not any(x in text for x in self.added):
            return self.cut.findall(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [*self.cut.findall(text[at : m.start()]), m[0]]
            at = m.end()
        return out + self.cut.findall(text[at:])


def _packed(values: np.ndarray, kind: str) -> bytes:
    """Numbers as their first bytes, then their second, ..., compressed."""
    planes = values.astype(kind).view(np.uint8).reshape(len(values), -1 if len(values) else 1).T
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True) if len(values) else b""


def _unpacked(raw: bytes, n: int, kind: str) -> np.ndarray:
    if not n:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.decompress(raw, n * np.dtype(kind).itemsize, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(-1, n).T).view(kind).ravel()


def _block(name: int, ids: list, texts: list[str], cut: _Cutter, n_buckets: int) -> pa.RecordBatch:
    """The rows of a block, one for each part."""
    known: dict[str, int] = {}
    codes, sizes = [], []
    for text in texts:
        tokens = cut(text)
        for x in {*tokens}.difference(known):
            known[x] = len(known)
        codes += [known[x] for x in tokens]
        sizes.append(len(tokens))
    n = len(texts)
    # by bucket, pre-token, document; in order, pre-tokens with a common beginning stand together and compress well
    ordered = sorted((zlib.crc32(x.encode()) % n_buckets, x) for x in known)
    tokens, bucket = [x for _, x in ordered], np.array([b for b, _ in ordered], np.int64)
    place = np.empty(len(tokens), np.int64)
    place[[known[x] for x in tokens]] = np.arange(len(tokens))
    codes = place[np.array(codes, np.int64)]
    keys, freqs = np.unique(codes * n + np.repeat(np.arange(n), sizes), return_counts=True)
    token, doc = np.divmod(keys, n)
    holders = np.bincount(token, minlength=len(known))
    upto = np.concatenate([[0], np.cumsum(holders)])
    weight = np.cumsum(holders + np.fromiter(map(len, tokens), np.int64, len(tokens)))
    begins = np.flatnonzero(np.diff(weight // PART, prepend=-1)) if tokens else np.zeros(1, np.int64)
    rows = []
    for i, (a, b) in enumerate(zip(begins, [*begins[1:], len(tokens)], strict=True)):
        buckets, cuts = np.unique(bucket[a:b], return_index=True)
        # the step from each document to the next, of 16 bits as they are
        steps = np.diff(doc[upto[a] : upto[b]].astype(np.uint16), prepend=np.uint16(0))
        of_docs = (None, None) if i else (ids, [len(x.encode()) for x in texts])
        rows.append((name + i, *of_docs, buckets, np.append(cuts, b - a), tokens[a:b], _packed(holders[a:b], "<u2"), _packed(steps, "<u2"), _packed(freqs[upto[a] : upto[b]], "<u4")))
    kinds = [pa.int64(), *[pa.list_(pa.int64())] * 2, *[pa.list_(pa.int32())] * 2, pa.list_(pa.string()), *[pa.binary()] * 3]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in _BLOCK.split(", ")])


def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the work
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.no_truncation()
    own.no_padding()
    return own


def frequencies(docs: DataFrame, path: str, n_buckets: int) -> DataFrame:
    """The blocks of all documents."""

    def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = _Cutter([x.content for x in _tokenizer(path).get_added_tokens_decoder().values()])
        name, ids, texts, size = TaskContext.get().partitionId() << 40, [], [], 0
        for batch in slices(batches):
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(i)
                texts.append(x or "")
                size += len(texts[-1])
                if size >= BLOCK_CHARS or len(ids) >= BLOCK_DOCS:
                    yield _block(name, ids, texts, cut, n_buckets)
                    name, ids, texts, size = name + (1 << PART_BITS), [], [], 0
        if ids:
            yield _block(name, ids, texts, cut, n_buckets)

    return docs.select(docs["doc_id"].cast("bigint"), docs["text"]).mapInArrow(invert, _BLOCK)


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in runs of rows with about ``STEP`` pre-tokens, a row at least."""
    for batch in batches:
        steps = np.cumsum(batch.column("tokens").value_lengths().to_numpy()) // STEP
        begins = np.flatnonzero(np.diff(steps, prepend=-1)).tolist()
        for a, b in zip(begins, [*begins[1:], len(batch)], strict=bool(begins)):
            yield batch.slice(a, b - a)


def piece_counts(parts: DataFrame, path: str) -> DataFrame:
    """block, at and pieces of each of the pre-tokens from ``at`` on: rows of bucket, block, at and tokens, sorted by bucket.

    A pre-token is counted at its first row; the counts of a bucket are held until the next begins, or they are ``KEEP``.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, known, held = _tokenizer(path), {}, None
        for batch in _steps(batches):
            bucket, lists = batch.column("bucket").to_numpy(), batch.column("tokens")
            if bucket[0] != held or len(known) > KEEP:
                known = {}
            flat = lists.flatten().to_pylist()
            if new := [*dict.fromkeys(x for x in flat if x not in known)]:
                known.update(zip(new, (len(e) for e in tokenizer.encode_batch_fast(new, add_special_tokens=False)), strict=True))
            cuts = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("at"), pa.ListArray.from_arrays(pa.array(cuts), pa.array([known[x] for x in flat], pa.int32()))], names=["block", "at", "pieces"])
            if bucket[-1] != held:
                held = bucket[-1]
                last = flat[cuts[np.flatnonzero(bucket == held)[0]] :]
                known = {x: known[x] for x in last}

    return parts.mapInArrow(count, "block bigint, at int, pieces array<int>")


def token_counts(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of each document."""
    n = partitions(docs.sparkSession)
    blocks = materialize(frequencies(docs, path, n * SUB), "frequencies", **{"parquet.block.size": GROUP_BYTES})
    parts = blocks.select("block", "cuts", "tokens", F.posexplode("buckets").alias("i", "bucket"))
    at, end = F.get("cuts", F.col("i")), F.get("cuts", F.col("i") + 1)
    parts = parts.select("bucket", "block", at.alias("at"), F.slice("tokens", at + 1, end - at).alias("tokens"))
    dealt = parts.repartitionById(n, F.floor(F.col("bucket") / SUB).cast("int")).sortWithinPartitions("bucket")
    # a part's frequencies come after the counts of all its pre-tokens
    last = blocks.select("block", F.lit(2**31 - 1).alias("at"), "ids", "n_bytes", "holders", "docs", "freqs")
    rows = piece_counts(dealt, path).unionByName(last, allowMissingColumns=True)
    rows = rows.repartition(n, F.shiftright("block", PART_BITS)).sortWithinPartitions("block", "at")

    def result(ids, n_bytes, total) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([ids, n_bytes, pa.array(total), pa.array(total > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, pieces = None, []
        for batch in batches:
            counts, ids, n_bytes, *packed = (batch.column(c) for c in ("pieces", "ids", "n_bytes", "holders", "docs", "freqs"))
            for i in range(len(batch)):
                if counts[i].is_valid:
                    pieces.append(counts[i].values.to_numpy().copy())
                    continue
                if ids[i].is_valid:
                    if held:
                        yield result(*held)
                    held = ids[i].values, n_bytes[i].values, np.zeros(len(ids[i].values), np.int64)
                own = np.concatenate([np.zeros(0, np.int32), *pieces])
                holders = _unpacked(packed[0][i].as_py(), len(own), "<u2")
                steps, freqs = (_unpacked(x[i].as_py(), int(holders.sum(dtype=np.int64)), kind) for x, kind in zip(packed[1:], ("<u2", "<u4"), strict=True))
                held[2][:] += np.bincount(np.cumsum(steps, dtype=np.uint16), np.repeat(own, holders) * freqs.astype(np.int64), len(held[2])).astype(np.int64)
                pieces = []
        if held:
            yield result(*held)

    return rows.mapInArrow(sums, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
