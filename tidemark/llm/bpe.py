"""Byte-level BPE encoding and decoding with segment trees over adjacent pair ranks.

Every pre-token is a row of leaves, one for each adjacent pair, holding the pair's merge rank.  The tree above them keeps
minima of ``rank * width + place``, so its root is the leftmost pair of lowest rank.  A merge changes three leaves (the
pair's own, and those of its left and right neighbours), each a walk of log2(width) nodes to the root, and the merging
ends when the root holds no rank.  Where every merge of a vocabulary ranks after those that make its parts, as in trained
ones, a merge can't make a pair of its own rank or a lower one: then all places of the root's rank, found from the root
down, are merged in one step, from left to right where they overlap; else only the leftmost.  Pre-tokens of like length
are trees of one shape, and numpy takes the same step in all of them at once; each distinct pre-token of a task is encoded
once and kept in a bounded table.

Defined results: a null text is an empty text, which has no ids and decodes to an empty text; equal rows give equal
rows; very long texts are read whole, and a pre-token of any length is one tree in memory; an empty table gives an empty result; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ._spark import slices

#: How byte-level BPE cuts a text into pre-tokens.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_NONE = np.int64(2**62)
#: Cells of the trees that one step works on.
_CELLS = 1 << 18
#: Distinct pre-tokens that a worker keeps at most; beyond it the table starts anew.
KEEP = 200_000


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: itself where printable, else 256 and up in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = (b for b in range(256) if b not in set(plain))
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Merges, ids and added strings of a byte-level BPE ``tokenizer.json``."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, alphabet = spec["model"]["vocab"], byte_alphabet()
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.size = max([*vocab.values(), *self.added.values()]) + 1
        self.pieces = [b""] * self.size
        for piece, i in vocab.items():
            if piece not in self.added:
                self.pieces[i] = bytes(alphabet[c] for c in piece)
        for piece, i in self.added.items():
            self.pieces[i] = piece.encode()
        self.of_byte = np.zeros(256, np.int64)
        for c, b in alphabet.items():
            self.of_byte[b] = vocab[c]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        #: Whether each merge ranks after those that make its parts.
        last = {}
        for rank, (a, b) in enumerate(pairs):
            last[a + b] = rank
        self.ordered = all(max(last.get(a, -1), last.get(b, -1)) < rank for rank, (a, b) in enumerate(pairs))
        self.piece_bytes = np.frombuffer(b"".join(self.pieces), np.uint8)
        self.piece_len = np.array([len(p) for p in self.pieces], np.int64)
        self.piece_at = np.concatenate([[0], np.cumsum(self.piece_len)[:-1]])

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge ranks of pairs of ids; a negative id or an unknown pair has none."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((left >= 0) & (right >= 0) & (self.keys[at] == key), self.ranks[at], _NONE)


class PairTrees:
    """Segment trees of one width over the pairs of many pre-tokens."""

    def __init__(self, vocab: Vocabulary, ids: np.ndarray, lengths: np.ndarray):
        self.vocab, (self.n, self.width) = vocab, ids.shape
        self.ids = ids
        place = np.arange(self.width)
        inside = place[None, :] < lengths[:, None]
        self.ids[~inside] = -1
        self.before = np.broadcast_to(place - 1, ids.shape).copy()
        self.after = np.where(place[None, :] + 1 < lengths[:, None], place[None, :] + 1, -1)
        self.tree = np.full((self.n, 2 * self.width), _NONE, np.int64)
        right = np.concatenate([ids[:, 1:], np.full((self.n, 1), -1, np.int64)], axis=1)
        self.tree[:, self.width :] = self._cell(vocab.rank(ids, right), place[None, :])
        lo = self.width
        while lo > 1:
            level = self.tree[:, lo : 2 * lo]
            self.tree[:, lo // 2 : lo] = np.minimum(level[:, 0::2], level[:, 1::2])
            lo //= 2

    def _cell(self, rank: np.ndarray, place: np.ndarray) -> np.ndarray:
        return np.where(rank == _NONE, _NONE, rank * self.width + place)

    def _put(self, rows: np.ndarray, place: np.ndarray, value: np.ndarray) -> None:
        """Point update: the leaf and its way to the root."""
        node = place + self.width
        self.tree[rows, node] = value
        while self.width > 1 and node.size and node[0] > 1:  # all leaves are equally deep
            node = node >> 1
            self.tree[rows, node] = np.minimum(self.tree[rows, 2 * node], self.tree[rows, 2 * node + 1])

    def _lowest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, place and rank of the pairs to merge next: those of the lowest rank of each row, which don't overlap."""
        rank, at = np.divmod(self.tree[rows, 1], self.width)
        if not self.vocab.ordered:
            return rows, at, rank
        node = np.ones(rows.size, np.int64)
        while node[0] < self.width:
            rows, rank, node = np.repeat(rows, 2), np.repeat(rank, 2), np.repeat(2 * node, 2)
            node[1::2] += 1
            on = self.tree[rows, node] < (rank + 1) * self.width
            rows, rank, node = rows[on], rank[on], node[on]
        at = node - self.width
        touching = (rows[1:] == rows[:-1]) & (at[1:] == self.after[rows[:-1], at[:-1]])
        if touching.any():
            index = np.arange(rows.size)
            first = np.maximum.accumulate(np.where(np.concatenate([[True], ~touching]), index, 0))
            on = (index - first) % 2 == 0
            rows, rank, at = rows[on], rank[on], at[on]
        return rows, at, rank

    def merge_all(self) -> None:
        open_rows = np.flatnonzero(self.tree[:, 1] != _NONE)
        while open_rows.size:
            rows, at, rank = self._lowest(open_rows)
            gone = self.after[rows, at]
            far = self.after[rows, gone]
            self.ids[rows, at] = self.vocab.merged[rank]
            self.ids[rows, gone] = -1
            self.after[rows, at] = far
            some = far >= 0
            self.before[rows[some], far[some]] = at[some]
            right = np.where(some, self.ids[rows, far], -1)
            prev = self.before[rows, at]
            some = prev >= 0
            r, p = rows[some], prev[some]
            # the three leaves of each merge go up together
            self._put(
                np.concatenate([rows, rows, r]), np.concatenate([gone, at, p]),
                np.concatenate([np.full(rows.size, _NONE), self._cell(self.vocab.rank(self.ids[rows, at], right), at), self._cell(self.vocab.rank(self.ids[r, p], self.ids[r, at[some]]), p)]),
            )
            open_rows = open_rows[self.tree[open_rows, 1] != _NONE]


def encode_pre_tokens(vocab: Vocabulary, pre_tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the pre-tokens end to end, and the count of each."""
    lengths = np.array([len(p) for p in pre_tokens], np.int64)
    flat = vocab.of_byte[np.frombuffer(b"".join(pre_tokens), np.uint8)] if len(pre_tokens) else np.zeros(0, np.int64)
    starts = np.cumsum(lengths) - lengths
    widths = 1 << np.ceil(np.log2(np.maximum(lengths, 2))).astype(np.int64)
    counts, parts = np.zeros(len(pre_tokens), np.int64), []
    for width in np.unique(widths):
        own = np.flatnonzero(widths == width)
        step = max(1, _CELLS // int(width))
        for chunk in (own[i : i + step] for i in range(0, len(own), step)):
            place = np.minimum(starts[chunk][:, None] + np.arange(width)[None, :], len(flat) - 1)
            trees = PairTrees(vocab, flat[place], lengths[chunk])
            trees.merge_all()
            left = trees.ids >= 0
            counts[chunk] = left.sum(axis=1)
            parts.append((chunk, trees.ids[left].astype(np.uint32)))
    ends = np.cumsum(counts)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint32)
    for chunk, ids in parts:
        out[spread(ends[chunk] - counts[chunk], counts[chunk])] = ids
    return out, counts


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of each range, end to end."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)


class Encoder:
    """Encodes and decodes texts; keeps the ids of distinct pre-tokens in a bounded table."""

    def __init__(self, path: str):
        self.vocab = Vocabulary(path)
        self.cut = regex.compile(PRE_TOKEN)
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.vocab.added, key=len, reverse=True))) or r"(?!)")
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.starts, self.lengths = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def pre_tokens(self, text: str) -> list[str]:
        """Pre-tokens, and the added strings whole."""
        if not any(x in text for x in self.vocab.added):
            return self.cut.findall(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [*self.cut.findall(text[at : m.start()]), m[0]]
            at = m.end()
        return out + self.cut.findall(text[at:])

    def _learn(self, new: list[str]) -> None:
        ids, counts = encode_pre_tokens(self.vocab, [x.encode() for x in new])
        for i, x in enumerate(new):
            if x in self.vocab.added:  # such a string is never a pre-token: its punctuation and letters are cut apart
                at = int(counts[:i].sum())
                ids = np.concatenate([ids[:at], [self.vocab.added[x]], ids[at + counts[i] :]]).astype(np.uint32)
                counts[i] = 1
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(counts) - counts])
        self.lengths = np.concatenate([self.lengths, counts])
        self.flat = np.concatenate([self.flat, ids])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts end to end, and the count of each."""
        if len(self.known) > KEEP:
            self._clear()
        known, codes, sizes, new = self.known, [], [], []
        for text in texts:
            tokens = self.pre_tokens(text)
            for x in {*tokens}.difference(known):
                known[x] = len(known)
                new.append(x)
            sizes.append(len(tokens))
            codes += [known[x] for x in tokens]
        if new:
            self._learn(new)
        codes_, sizes_ = np.array(codes, np.int64), np.array(sizes, np.int64)
        lengths = self.lengths[codes_]
        ids = self.flat[spread(self.starts[codes_], lengths)]
        upto = np.concatenate([[0], np.cumsum(lengths)])
        ends = np.cumsum(sizes_)
        return ids, upto[ends] - upto[ends - sizes_]

    def decode_bytes(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes of all ids, and where those of each id end."""
        lengths = self.vocab.piece_len[ids]
        return self.vocab.piece_bytes[spread(self.vocab.piece_at[ids], lengths)].tobytes(), np.cumsum(lengths)


def text_chunks(texts: Iterable[str], most: int = 1 << 20) -> Iterator[list[str]]:
    """Runs of whole texts of about ``most`` characters."""
    run, size = [], 0
    for x in texts:
        run.append(x)
        size += len(x)
        if size >= most:
            yield run
            run, size = [], 0
    if run:
        yield run


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each vocabulary in a worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def with_ids(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array of int) and the decoded text of each document."""
    return _encoded(docs, path, "doc_id bigint, ids array<int>, decoded string", lambda ids, back: (pa.array(ids.astype(np.int32)), back.decode("utf-8", "replace")), lambda rows: [pa.array([r[0].to_pylist() for r in rows], pa.list_(pa.int32())), pa.array([r[1] for r in rows], pa.string())])


def bpe_round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each document, from its ids and from what they decode to."""

    def digest(ids, back):
        return len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(back.decode("utf-8", "replace").encode()).hexdigest()

    return _encoded(docs, path, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string", digest, lambda rows: [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string()))])


def _encoded(docs: DataFrame, path: str, schema: str, make, columns) -> DataFrame:
    names = [x.strip().split(" ")[0] for x in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in slices(batches):
            rows = []
            for texts in text_chunks(x or "" for x in batch.column(1).to_pylist()):
                ids, counts = bpe.encode(texts)
                back, ends = bpe.decode_bytes(ids)
                at = done = 0
                for n in counts.tolist():
                    end = int(ends[at + n - 1]) if n else done
                    rows.append(make(ids[at : at + n], back[done:end]))
                    at, done = at + n, end
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns(rows)], names=names)

    return docs.select(docs["doc_id"].cast("bigint"), docs["text"]).mapInArrow(run, schema)
