"""Token ids in compressed shards with a shared zstandard dictionary.

A document's ids are 16-bit or 32-bit little-endian numbers, compressed by themselves with a dictionary that was trained
on serialized id arrays of a bounded sample, so that a short document can be read without its neighbours.

File format: a Parquet table with a row for each shard, in ascending doc_id order by (part, seq):

    part, seq       the place of the shard; doc_ids ascend with it
    dict_sha256     hash of the dictionary that its frames need
    width           bytes of an id, 2 or 4
    base            ids in earlier shards of the part
    first, last     the least and greatest doc_id of the shard, null without any: shards without a doc_id are skipped by them
    doc_ids, known  one 64-bit doc_id for each document, and 1 where it is not null
    n_ids           ids of each document
    offsets         where each document's frame begins in ``frames``, and where the last ends
    frames          the documents' zstandard frames end to end

Documents with a null doc_id come first; rows of equal doc_id are ordered by the hash of their ids.  A null text is an
empty text: its only id is the end id.  Equal rows are documents of their own.  Very long texts are encoded whole.
An empty table gives an empty store.  Other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import materialize, partitions
from .bpe import spread, text_chunks

#: Documents and bytes that the dictionary may be trained on, and its size.
SAMPLE_DOCS, SAMPLE_BYTES, DICT_BYTES = 2000, 8 << 20, 64 << 10
SHARD_BYTES = 4 << 20
#: Words whose ids a worker keeps at most; beyond it the table starts anew.
KEEP = 800_000
#: New words of a call of the tokenizer.
WORDS = 20_000
#: Bytes of the texts whose words are sought at once.
RUN_BYTES = 4 << 20
#: Pre-tokens of the tokenizers whose words are cut into letters and signs.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Latin letters, and ASCII signs but for the apostrophe: two such pre-tokens at most.  A dotted capital I becomes more than letters.
LETTERS_SIGNS = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+)([!-&(-/:-@\\[-`{-~]*)")

SHARD = "part int, seq int, dict_sha256 string, width int, base bigint, total bigint, first bigint, last bigint, doc_ids binary, known binary, n_ids binary, offsets binary, frames binary"


class Codes(dict):
    """Numbers of words by first sight; those that are seen for the first time are also in ``new``."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = code = len(self)
        self.new.append(word)
        return code


def _cut(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, str]:
    """Where the words of each text begin, and of the last end; each word's place among the distinct words; these, joined by blanks."""
    words = pc.ascii_split_whitespace(texts)
    upto = np.asarray(words.offsets)
    distinct = words.values.slice(int(upto[0]), int(upto[-1] - upto[0])).dictionary_encode()
    joined = pc.binary_join(pa.LargeListArray.from_arrays([0, len(distinct.dictionary)], distinct.dictionary), " ")[0].as_py()
    return upto - upto[0], np.asarray(distinct.indices), joined


class WordTable:
    """Ids of texts by way of their distinct words.

    For tokenizers that drop white space and treat what lies between by itself (normalisers and pre-tokenizers that never
    look across it), the ids of a text are those of its words end to end.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the work
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        # where the tokenizer makes capitals small, words that differ by them alone are one; not beside its special strings
        capitals = bytes(range(65, 91)).decode()
        self.small = self.tokenizer.normalizer is not None and self.tokenizer.normalizer.normalize_str(capitals) == capitals.lower()
        self.special = [t.content.encode().lower().decode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.ends = self._ends()
        self._clear()

    def _ends(self) -> np.ndarray | None:
        """For each id, whether it ends a pre-token; none where ids don't tell it or where letters can't be parted from signs."""
        from tokenizers.pre_tokenizers import ByteLevel

        config = json.loads(self.tokenizer.to_str())
        model, suffix = config["model"], config["model"].get("end_of_word_suffix")
        normal, cut = config["normalizer"] or {"normalizers": []}, (config["pre_tokenizer"] or {}).get("pretokenizers", [])
        if model["type"] != "BPE" or not suffix or model["continuing_subword_prefix"] or any(LETTERS_SIGNS.fullmatch("a" + s) for s in self.special):
            return None
        if any(x["type"] not in ("NFC", "Lowercase") and x != {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "} for x in normal.get("normalizers", [normal])):
            return None
        if [x["type"] for x in cut] != ["Split", "ByteLevel"] or (cut[0]["pattern"], cut[0]["behavior"], cut[0]["invert"]) != ({"Regex": PRE_TOKEN}, "Removed", True):
            return None
        if not all(c + suffix in model["vocab"] for c in ByteLevel.alphabet()):  # a pre-token might end without the suffix
            return None
        ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        ends[[i for token, i in model["vocab"].items() if token.endswith(suffix)]] = True
        return ends

    def _clear(self) -> None:
        self.known = Codes()
        self.flat, self.starts, self.lengths = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, texts: list[str] | pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, each with ``end`` after it, and the count of each."""
        if len(self.known) > KEEP or not self.known:
            self._clear()
            self.known[" "] = 0  # stands for the end id; no word is a blank
            self.flat, self.starts, self.lengths = np.array([end], np.uint32), np.zeros(1, np.int64), np.ones(1, np.int64)
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        small = pc.ascii_lower(texts) if self.small else texts
        upto, indices, words = _cut(small)
        if self.small and any(s in words for s in self.special):
            as_is = functools.reduce(pc.or_, [pc.match_substring(small, s) for s in self.special])
            upto, indices, words = _cut(pc.if_else(as_is, texts, small))
        words = words.split(" ")
        own = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        if self.known.new:
            self._add(self.known.new)
        # the end id's code is 0
        codes = np.insert(own[indices], upto[1:], 0)
        sizes = np.diff(upto) + 1
        lengths, ends = self.lengths[codes], np.cumsum(sizes)
        upto = np.concatenate([[0], np.cumsum(lengths)])
        return self.flat[spread(self.starts[codes], lengths)], upto[ends] - upto[ends - sizes]

    def _add(self, new: list[str]) -> None:
        """Finds the ids of the new words; letters with signs after them have the ids of both, end to end."""
        first, code, plain, odd, pairs = len(self.lengths), self.known.__getitem__, [], [], []
        for at, word in enumerate(new, first):  # letters and signs that were not known join the new words
            found = LETTERS_SIGNS.fullmatch(word) if self.ends is not None else None
            if not found:
                odd.append(at)
            elif found[2]:
                pairs.append((at, code(found[1]), code(found[2])))
            else:
                plain.append(at)
        self.starts, self.lengths = (np.concatenate([x, np.zeros(len(new), np.int64)]) for x in (self.starts, self.lengths))
        for codes, ids_of in ((plain, self._letters), (odd, self._words)):
            found = [ids_of([new[c - first] for c in codes[i : i + WORDS]]) for i in range(0, len(codes), WORDS)]
            if found:
                self._put(codes, *map(np.concatenate, zip(*found, strict=True)))
        if pairs:
            words, both = np.array(pairs, np.int64)[:, 0], np.array(pairs, np.int64)[:, 1:]
            counts = self.lengths[both]
            self._put(words, self.flat[spread(self.starts[both].ravel(), counts.ravel())], counts.sum(axis=1))
        self.known.new = []

    def _put(self, codes: list[int] | np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        self.starts[codes], self.lengths[codes] = len(self.flat) + np.cumsum(counts) - counts, counts
        self.flat = np.concatenate([self.flat, ids])

    def _letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and counts of runs of letters, tokenised as one text: each is one pre-token, whose last id ends it."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(self.ends[ids])
        # none has less than one pre-token, so as many ends as words are one for each
        return (ids, np.diff(ends, prepend=-1)) if len(ends) == len(words) else self._words(words)

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words end to end, and the count of each; each word is tokenised by itself, in one call."""
        found = self.tokenizer.encode(words, is_pretokenized=True, add_special_tokens=False)
        return np.array(found.ids, np.uint32), np.bincount(np.array(found.word_ids, np.int64), minlength=len(words))


_tables: dict[str, WordTable] = {}


def _table(path: str) -> WordTable:
    if path not in _tables:
        _tables[path] = WordTable(path)
    return _tables[path]


def _runs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of whole texts, the second column, of about ``RUN_BYTES``."""
    at = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(1)), 0)), dtype=np.int64) // RUN_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(batch)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a)


def _raw(ids: np.ndarray, width: int) -> bytes:
    return ids.astype("<u2" if width == 2 else "<u4").tobytes()


def train_dictionary(docs: DataFrame, path: str, end: int) -> bytes:
    """A dictionary from whole documents of a bounded sample.

    The sample is the ``SAMPLE_DOCS`` documents of the least hashes of their ids; one that doesn't fit in what those before
    it leave of ``SAMPLE_BYTES`` is passed over, whatever its length.  The dictionary is empty, and frames are compressed
    without one, where the sample is too little to learn from.
    """
    # SAMPLE_DOCS ids at most: a bounded table; texts are read for them alone
    chosen = docs.select("doc_id").filter(F.col("doc_id").isNotNull()).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS)
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.xxhash64("text")]
    near = docs.select("doc_id", "text", F.octet_length("text").alias("n")).filter("n > 0").join(F.broadcast(chosen), "doc_id", "left_semi")
    sized = near.select(*(c.alias(f"k{i}") for i, c in enumerate(order)), "n").orderBy("k0", "k1", "k2").limit(SAMPLE_DOCS).collect()
    left, taken = SAMPLE_BYTES, set()
    for r in sized:
        if r["n"] <= left:
            left -= r["n"]
            taken.add((r["k1"], r["k2"]))
    if not taken:
        return b""
    fits = F.broadcast(docs.sparkSession.createDataFrame([*taken], "doc_id bigint, hash bigint"))  # SAMPLE_DOCS rows at most
    rows = near.withColumn("hash", order[2]).withColumn("doc_id", F.col("doc_id").cast("bigint")).join(fits, ["doc_id", "hash"], "left_semi").dropDuplicates(["doc_id", "hash"]).collect()
    texts = [r["text"] for r in sorted(rows, key=lambda r: (r["doc_id"], r["hash"]))]
    table, samples, size = WordTable(path), [], 0
    for chunk in text_chunks(texts):
        ids, counts = table.encode(chunk, end)
        for part in np.split(ids, np.cumsum(counts)[:-1]):
            samples.append(_raw(part, table.width))
            size += len(samples[-1])
    try:
        return zstandard.train_dictionary(min(DICT_BYTES, max(1024, size // 20)), samples).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too little to learn from
        return b""


def _dictionary(dictionary: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(dictionary) if dictionary else None


def write_store(docs: DataFrame, path: str, dictionary: bytes, end: int = 1) -> DataFrame:
    """The shards of all documents in ascending doc_id order, written to the shared folder."""
    spark = docs.sparkSession
    sha = hashlib.sha256(dictionary).hexdigest()
    frame_cols = "doc_id bigint, width int, n_ids bigint, tie bigint, frame binary"

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(path)
        zipped = zstandard.ZstdCompressor(level=3, dict_data=_dictionary(dictionary))
        for batch in batches:
            for run in _runs(batch):
                ids, counts = table.encode(pc.fill_null(run.column(1), ""), end)
                raw, ends, frames, ties = _raw(ids, table.width), (np.cumsum(counts) * table.width).tolist(), [], []
                for a, b in zip([0, *ends], ends, strict=False):
                    frames.append(zipped.compress(raw[a:b]))
                    ties.append(zlib.crc32(raw[a:b]))
                yield pa.RecordBatch.from_arrays([run.column(0), pa.array([table.width] * len(ties), pa.int32()), pa.array(counts, pa.int64()), pa.array(ties, pa.int64()), pa.array(frames, pa.binary())], names=["doc_id", "width", "n_ids", "tie", "frame"])

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, base, held, size = TaskContext.get().partitionId(), 0, 0, [], 0

        def flush():
            nonlocal seq, base, held, size
            n_ids = np.array([r[2] for r in held], "<i8")
            total, offsets = int(n_ids.sum()), np.concatenate([[0], np.cumsum([len(r[3]) for r in held])]).astype("<i8")
            known = [r[0] for r in held if r[0] is not None]
            row = (part, seq, sha, held[0][1], base, total, min(known, default=None), max(known, default=None), np.array([r[0] or 0 for r in held], "<i8").tobytes(), bytes(r[0] is not None for r in held), n_ids.tobytes(), offsets.tobytes(), b"".join(r[3] for r in held))
            types = [pa.int32(), pa.int32(), pa.string(), pa.int32(), *[pa.int64()] * 4, *[pa.binary()] * 5]
            seq, base, held, size = seq + 1, base + total, [], 0
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], names=[x.split()[0] for x in SHARD.split(", ")])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(row)
                size += len(row[3])
                if size >= SHARD_BYTES:
                    yield flush()
        if held:
            yield flush()

    frames = docs.select(docs["doc_id"].cast("bigint"), docs["text"]).mapInArrow(compress, frame_cols)
    # sampling for the ranges would encode everything twice
    frames = materialize(frames.withColumn("row", F.monotonically_increasing_id()), "frames")
    # numbered, so that rows of one doc_id and text, however many, are more than one range
    frames = frames.repartitionByRange(partitions(spark), "doc_id", "tie", "row").sortWithinPartitions("doc_id", "tie", "row")
    return materialize(frames.select("doc_id", "width", "n_ids", "frame").mapInArrow(shards, SHARD), "shards")


def read_store(store: DataFrame, dictionary: bytes) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the shards."""
    sha = hashlib.sha256(dictionary).hexdigest()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))
        for batch in batches:
            for s in batch.to_pylist():
                if s["dict_sha256"] != sha:
                    raise ValueError(f"the shard needs dictionary {s['dict_sha256']}, not {sha}")
                offsets, n_ids = np.frombuffer(s["offsets"], "<i8").tolist(), np.frombuffer(s["n_ids"], "<i8")
                crcs = []
                for a, b, n in zip(offsets, offsets[1:], n_ids.tolist(), strict=False):
                    ids = np.frombuffer(unzip.decompress(s["frames"][a:b], n * s["width"]), "<u2" if s["width"] == 2 else "<u4")
                    if len(ids) != n:
                        raise ValueError("a frame and the index disagree")
                    crcs.append(zlib.crc32(ids.astype("<u4").tobytes()))
                ids_ = pa.array(np.frombuffer(s["doc_ids"], "<i8"), mask=np.frombuffer(s["known"], "u1") == 0)
                starts = s["before"] + s["base"] + np.cumsum(n_ids) - n_ids
                yield pa.RecordBatch.from_arrays([ids_, pa.array(starts, pa.int64()), pa.array(n_ids, pa.int64()), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    # a row for each part, so the window over all of them stays small
    totals = store.groupBy("part").agg(F.sum("total").alias("total"))
    before = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))
    # as many rows as the ranges that the store was written in, the shuffle partitions of that session: a bounded table
    return store.join(F.broadcast(before), "part").mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def read_document(store: DataFrame, dictionary: bytes, doc_id: int) -> list[list[int]]:
    """Ids of the documents of one doc_id: other shards are skipped by their least and greatest ids, and of a shard that has
    it only its own frames are cut out and decompressed, where the shard is."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))
        for batch in batches:
            for s in batch.to_pylist():
                offsets, own = np.frombuffer(s["offsets"], "<i8"), np.frombuffer(s["doc_ids"], "<i8") == doc_id
                at = np.flatnonzero(own & (np.frombuffer(s["known"], "u1") == 1)).tolist()
                found = [np.frombuffer(unzip.decompress(s["frames"][offsets[i] : offsets[i + 1]]), "<u2" if s["width"] == 2 else "<u4").tolist() for i in at]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int64()))], names=["ids"])

    near = store.filter((F.col("first") <= doc_id) & (F.col("last") >= doc_id)).orderBy("part", "seq")
    return [r["ids"] for r in near.select("doc_ids", "known", "width", "offsets", "frames").mapInArrow(cut, "ids array<bigint>").collect()]


def token_store(docs: DataFrame, path: str, end: int = 1) -> DataFrame:
    """Write all documents with a dictionary of their own, read them back: one row for each."""
    dictionary = train_dictionary(docs, path, end)
    return read_store(write_store(docs, path, dictionary, end), dictionary)
