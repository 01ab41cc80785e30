"""SimHash near-duplicates with a Gray-order hierarchical index.

Fingerprints that differ in at most ``k`` of 64 bits are linked.  The top nodes of the index are masked bit patterns: the
64 bits are cut into ``k + shared`` blocks, and linked fingerprints agree on at least ``shared`` of them, so each choice of
so many blocks is a mask, each mask with its bits a node, and each link lies under one node at least.  Top nodes are dealt
to tasks.  Under each of them the fingerprints stand in the order of their Gray rank; runs of ``FAN`` of them are nodes
with the bits that all their members share, runs of ``FAN`` such nodes are nodes in turn, and so on up to one root.

A search goes down pairs of nodes, from each root with itself.  A pair keeps the bits that were compared and how many of
them differ; a level down, only the bits that both nodes share now and that were not compared before are added.  A pair
whose differences exceed ``k`` is pruned with all that lies under it, and so is a pair whose members are linked already.
What is left at the lowest level are links.  All nodes and pairs of a level are numpy arrays, over all top nodes of a task
at once.  ``Search`` counts what was compared and pruned.

A top node of more than ``HOT`` fingerprints is cut into cells of pairs of slices, each a group of its own with two roots,
so that no key is too large for a task; no link is lost.  Equal texts share a fingerprint and enter the index once.  A
task reports a tree of each set of fingerprints that its links join.  Components come from large-star and small-star
rounds on fingerprints, each round written to the shared folder.

Defined results: a null or wordless text has fingerprint zero, linked like any other; rows with a null doc_id get a
fingerprint and the least known doc_id of their component, null if it has none; equal rows give equal rows; very long
texts are read whole; an empty table gives an empty result; other columns are ignored, and kept by ``representatives``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ._spark import joined, materialize, partitions, whole

SHINGLE, DISTANCE, SEED = 4, 4, 42
#: Members of a node of the index, and fingerprints of a top node that one group holds.
FAN, HOT = 8, 4096
#: Evenly spread fingerprints that a top node is to hold at most; masks take in more blocks until it does.
MEMBERS = 16
#: Pairs of nodes that are expanded at a time, and fingerprints from which a task searches what it holds.
_PAIRS, _ROWS = 1 << 14, 1 << 18


def fingerprint(text: str, words_each: int = SHINGLE) -> int:
    """The bits that are set in over half of the shingles' hashes."""
    words = text.encode().lower().split()  # bytes: only A-Z are lowered, only ASCII white space cuts
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= words_each:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum(np.array([len(w) + 1 for w in words]))
        starts = np.concatenate([[0], ends[:-1]])[: len(words) - words_each + 1].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, (ends[words_each - 1 :] - 1).tolist(), strict=True)]
    bits = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 8192):
        part = np.array(hashes[i : i + 8192], "<u8")
        bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view("<u8")[0])


@F.pandas_udf(LongType())
def _fingerprint_column(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(x or "") for x in texts], np.uint64).view(np.int64))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of each document."""
    return docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), _fingerprint_column(docs["text"]).alias("fp"))


def shared_blocks(n: int, k: int = DISTANCE, members: int = MEMBERS) -> int:
    """How many blocks a mask holds: the fewest that leave ``n`` evenly spread fingerprints in top nodes of ``members``.

    So comparisons grow with ``n`` and not with its square; the links found are the same for any number of blocks.
    """
    shared = 1
    while shared < 8 and n >> (shared * (64 // (k + shared))) > members:
        shared += 1
    return shared


def masks(k: int = DISTANCE, shared: int = 1) -> list[int]:
    """The choices of ``shared`` blocks of bits of which linked fingerprints agree on at least one whole."""
    n = k + shared
    cuts = [64 * i // n for i in range(n + 1)]
    blocks = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]
    return [sum(chosen) for chosen in combinations(blocks, shared)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each code in the Gray sequence."""
    out = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(s)
    return out


class Search:
    """Links under the top nodes of a task: ``fps`` in groups from ``starts`` on, each in Gray order.

    ``roots`` are the pairs of groups to search.  After ``run``, ``label`` has the least place that links reach from each.
    """

    def __init__(self, fps: np.ndarray, starts: np.ndarray, roots: np.ndarray, k: int):
        self.k, self.fps, self.label = k, fps, np.arange(len(fps))
        self.compared = self.pruned = self.linked = self.pairs = 0
        ends = np.append(starts[1:], len(fps)) if len(starts) else starts
        # a level: bits that all members have, bits that they all lack, and where the members of each node begin and end
        self.levels = [(fps, ~fps, None, None)]
        lo, hi = starts, ends
        while True:
            ones, zeros, _, _ = self.levels[-1]
            n = -(-(hi - lo) // FAN)
            at = np.cumsum(n) - n
            first = np.repeat(lo, n) + FAN * (np.arange(n.sum()) - np.repeat(at, n))
            last = np.minimum(first + FAN, np.repeat(hi, n))
            self.levels.append((np.bitwise_and.reduceat(ones, first), np.bitwise_and.reduceat(zeros, first), first, last))
            if (n == 1).all():
                break
            lo, hi = at, at + n
        self.roots = roots

    def run(self) -> np.ndarray:
        a, b = self.roots[:, 0], self.roots[:, 1]
        todo = [(len(self.levels) - 1, a, b, np.zeros(len(a), np.uint64), np.zeros(len(a), np.uint8))]
        while todo:
            level, a, b, seen, off = todo.pop()
            for at in range(0, len(a), _PAIRS):
                part = slice(at, at + _PAIRS)
                below = self._expand(level, a[part], b[part], seen[part], off[part])
                if level > 1 and len(below[0]):
                    todo.append((level - 1, *below))
        return self.label

    def _expand(self, level: int, a: np.ndarray, b: np.ndarray, seen: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
        """The pairs of members of pairs of nodes that may hold links; at the lowest level the links join their ends."""
        _, _, first, last = self.levels[level]
        if level == 1 and self.linked:  # a pair of runs whose members are all linked has nothing to add
            least, most = np.minimum.reduceat(self.label, first), np.maximum.reduceat(self.label, first)
            news = ~((least[a] == most[a]) & (least[b] == most[b]) & (least[a] == least[b]))
            self.pruned += int(len(a) - news.sum())
            a, b, seen, off = a[news], b[news], seen[news], off[news]
        step = np.arange(FAN)
        x, y = np.broadcast_arrays((first[a][:, None] + step)[:, :, None], (first[b][:, None] + step)[:, None, :])
        real = (x < last[a][:, None, None]) & (y < last[b][:, None, None])
        real &= (a != b)[:, None, None] | (x < y if level == 1 else x <= y)
        pair = np.broadcast_to(np.arange(len(a))[:, None, None], x.shape)[real]
        x, y = x[real], y[real]
        ones, zeros, _, _ = self.levels[level - 1]
        # bits that the members of both sides share, and those of them that differ
        both, differ = (ones[x] | zeros[x]) & (ones[y] | zeros[y]) & ~seen[pair], (ones[x] & zeros[y]) | (zeros[x] & ones[y])
        total = off[pair] + np.bitwise_count(differ & both)
        near = total <= self.k
        self.compared += len(x)
        self.pruned += int(len(x) - near.sum())
        x, y = x[near], y[near]
        if level > 1:
            return x, y, (seen[pair] | both)[near], total[near]
        self.pairs += len(x)
        self._join(x, y)
        return x, y

    def _join(self, x: np.ndarray, y: np.ndarray) -> None:
        label = self.label
        while True:
            a, b = label[x], label[y]
            apart = a != b
            if not apart.any():
                return
            x, y, a, b = x[apart], y[apart], a[apart], b[apart]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(further := label[label], label):
                label[:] = further
            self.linked += 1


def search(node: np.ndarray, side: np.ndarray, fps: np.ndarray, k: int) -> Search:
    """The search of rows sorted by node and side.  side: 0 for the whole of a node, else 1 and 2: only pairs across count."""
    # a fingerprint that is alone under its node has nobody to meet there
    new = np.concatenate([[True], node[1:] != node[:-1], [True]])
    company = ~(new[:-1] & new[1:])
    node, side, fps = node[company], side[company], fps[company]
    if not len(fps):
        return Search(fps, np.zeros(0, np.int64), np.zeros((0, 2), np.int64), k)
    group = np.flatnonzero(np.concatenate([[True], (node[1:] != node[:-1]) | (side[1:] != side[:-1])]))
    sizes = np.diff(np.append(group, len(fps)))
    fps = fps[np.lexsort((gray_rank(fps), np.repeat(np.arange(len(group)), sizes)))]
    one = np.flatnonzero(side[group] == 0)
    two = np.flatnonzero((side[group][:-1] == 1) & (side[group][1:] == 2) & (node[group][:-1] == node[group][1:]))
    return Search(fps, group, np.concatenate([np.stack([one, one], 1), np.stack([two, two + 1], 1)]), k)


def links(distinct: DataFrame, k: int = DISTANCE, hot: int = HOT) -> DataFrame:
    """a, b: pairs that join what links between distinct fingerprints (column fp) at up to ``k`` bits join."""
    spark = distinct.sparkSession
    chosen = masks(k, shared_blocks(distinct.count(), k))
    of = F.array(*(F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("bits")) for i, m in enumerate(chosen)))
    placed = distinct.select("fp", F.explode(of).alias("n")).select("fp", F.xxhash64("n.mask", "n.bits").alias("node"))
    # nodes that are too large: each has over ``hot`` rows, so few rows say which they are, and how to cut them
    large = placed.groupBy("node").agg(F.count("*").alias("n")).filter(F.col("n") > hot)
    slices = F.ceil(F.col("n") / F.lit(hot)).cast("int")
    own = F.pmod(F.xxhash64("fp", F.lit(1)), slices).cast("int")
    other = F.sequence(F.lit(0), slices - 1)
    cells = F.transform(other, lambda o: F.struct(F.least(own, o).alias("lo"), F.greatest(own, o).alias("hi"), F.when(own == o, 0).when(own < o, 1).otherwise(2).alias("side")))
    cut = placed.join(large, "node").select("fp", "node", F.explode(cells).alias("c")).select(F.xxhash64("node", "c.lo", "c.hi").alias("node"), F.col("c.side").alias("side"), "fp")
    rows = placed.join(large, "node", "left_anti").select("node", F.lit(0).alias("side"), "fp").unionByName(cut)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def out(node, side, fps):
            found = search(node, side, fps.view(np.uint64), k)
            label = found.run()
            at = np.flatnonzero(label != np.arange(len(label)))
            return pa.RecordBatch.from_arrays([pa.array(found.fps[at].view(np.int64)), pa.array(found.fps[label[at]].view(np.int64))], names=["a", "b"])

        size = 0
        for batch in batches:
            if not len(batch):
                continue
            held.append(tuple(c.to_numpy() for c in batch.columns))
            size += len(batch)
            if size >= _ROWS and held[0][0][0] != held[-1][0][-1]:
                node, side, fps = (np.concatenate(x) for x in zip(*held, strict=True))
                last = np.searchsorted(node, node[-1])  # the last node may go on in the next batch
                yield out(node[:last], side[:last], fps[:last])
                held, size = [(node[last:], side[last:], fps[last:])], len(node) - last
        if held:
            yield out(*(np.concatenate(x) for x in zip(*held, strict=True)))

    dealt = rows.repartition(partitions(spark), "node").sortWithinPartitions("node", "side")
    return dealt.mapInArrow(find, "a bigint, b bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root: the least node of each component of the graph with edges a, b, by large-star and small-star rounds.

    A node with many neighbours is a hot key of the joins; ``joined`` deals its rows apart.
    """
    now = materialize(edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")

    def state(df: DataFrame) -> tuple:
        # sums wrap around; equal states mean equal sets of edges but for one case in 2 ** 64
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    was, seen = None, state(now)
    while seen[0] and was != seen:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count_if(F.col("v") > F.col("u")).alias("n")), "least")
        large = materialize(joined(both.filter("v > u"), least, "u", "n", seen[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "least")
        small = joined(large, least, "u", "n", seen[0]).filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "stars")
        was, seen = seen, state(now)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _components_of(own: DataFrame, k: int) -> tuple[DataFrame, int]:
    """fp, n (rows that have it), root and component_id of each fingerprint of ``own`` (doc_id, fp), and the rows in all."""
    least = materialize(own.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")), "distinct")
    roots = components(links(least.select("fp"), k))
    rooted = materialize(least.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "n", "first_id", F.coalesce("root", "fp").alias("root")), "rooted")
    firsts = materialize(rooted.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("members")), "firsts")
    size = rooted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    return materialize(joined(rooted.drop("first_id"), firsts, "root", "members", size[0]), "components"), size[1]


def near_duplicates(docs: DataFrame, k: int = DISTANCE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (least doc_id that links reach) of each document."""
    own = materialize(fingerprints(docs), "fingerprints")
    of, total = _components_of(own, k)
    return joined(own, of.select("fp", "n", "component_id"), "fp", "n", total).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, k: int = DISTANCE) -> DataFrame:
    """One document of each component, with the columns and values of ``docs``: that of the least doc_id.

    Of several rows with that doc_id, the one of the least fingerprint and then the least hash of all its columns stays.
    Of a component without any doc_id, one row stays in the same way.
    """
    held = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), _fingerprint_column("text").alias("fp"), F.xxhash64(whole(docs)).alias("hash"))
    held = materialize(held, "fingerprints")
    of, total = _components_of(held, k)
    rows = joined(held, of.drop("component_id"), "fp", "n", total)
    # the least (doc_id, fp, hash) of each component, nulls last; partial minima go first, so a large one is no heavy key
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("fp").alias("fp"), F.col("hash").alias("hash"))
    picked = materialize(rows.groupBy("root").agg(F.min(order).alias("p")).select("p.doc_id", "p.fp", "p.hash"), "picked")
    keyed = docs.select(whole(docs).alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(whole(docs)).alias("hash"))
    # rows of one doc_id and hash are equal: any of them will do; what has no doc_id meets by the hash alone
    known = keyed.join(picked.filter("doc_id IS NOT NULL").select("doc_id", "hash"), ["doc_id", "hash"], "left_semi").dropDuplicates(["doc_id", "hash"])
    nameless = keyed.filter("doc_id IS NULL").join(picked.filter("doc_id IS NULL").select("hash"), "hash", "left_semi").dropDuplicates(["hash"])
    return known.select("row.*").unionByName(nameless.select("row.*"))
