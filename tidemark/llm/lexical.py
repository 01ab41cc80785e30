"""Ranked lexical search over a tiered index with residual bounds.

A document's score for an item is the sum of gains of the item's terms in it: a term's weight times the impact of its
occurrences there.  Postings (term, document, gain) of the terms that items ask for are written tier by tier, those of high
gain first; a posting's tier goes by its gain drawn towards the greatest gain of its term, so that the lists of rare terms
are in upper tiers but for their tails, and those of common words in the lowest.  For each term and tier a residual bound
holds the greatest gain in the tiers below.

A search reads the first tier for all items and adds up gains.  The exact scores of each item's best documents so far give
a threshold.  If the residual bounds of an item's terms together stay below it, no document that wasn't met can be among
its best: the item is proven, and only its documents whose sum and residual bounds together reach the threshold are
completed from the lower tiers.  Items that lack this proof fall through to the next tier, down to the last one, after
which all sums are exact.

A filter of a bounded number of bits drops terms that no item has while texts are read; joins decide.  A tier is read in
parallel and no term's list is one task's.  The items' terms are broadcast if they are ``BROADCAST_ROWS`` at most; beyond
that terms are shuffled and those that many postings have are dealt out.

Defined results: a null or wordless text is no document and has no place in N; repeated documents are documents each,
and null ids come last among equal scores; equal items of one id are one item; a null or wordless item, and an item whose
terms have no weight, gets no rows; very long texts are counted piece by piece, whole; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import joined, materialize, slices, text_or_empty
from .words import dealt_join, filter_bits, may_hold, pieces

TOP = 20
#: A tier ends at this share of the greatest gain; the last one holds the rest.
TIERS = (0.4, 0.25, 0.16, 0.1, 0.06, 0.03)
#: How strongly a posting's own gain is drawn towards the greatest of its term.
DRAWN = 3
#: Rows of at most some 100 bytes that may be broadcast.
BROADCAST_ROWS = 100_000
#: Terms that a worker remembers whether they are asked for.
REMEMBERED = 200_000


def _counted(text: str) -> Counter:
    found: Counter = Counter()
    for words in pieces(text):
        found.update(words)
    return found


def _scanned(docs: DataFrame, asked: np.ndarray) -> DataFrame:
    """row, doc_id, n and the counts of terms that some item may ask for, of each document with a term; written, so that row is fixed."""
    kind = pa.list_(pa.struct([("term", pa.string()), ("tf", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row, known = TaskContext.get().partitionId() << 33, {}
        for batch in slices(batches):
            sizes, terms = [], []
            for text in batch.column("text"):
                found = _counted(text.as_py())
                new = [w for w in found if w not in known]
                if new:
                    if len(known) > REMEMBERED:
                        known, new = {}, list(found)
                    hashes = np.fromiter(map(xxhash.xxh64_intdigest, new), np.uint64, len(new))
                    known.update(zip(new, may_hold(asked, hashes).tolist(), strict=True))
                sizes.append(found.total())
                terms.append([{"term": w.decode("utf-8", "replace"), "tf": n} for w, n in found.items() if known[w]])
            yield pa.RecordBatch.from_arrays([pa.array(range(row, row + len(sizes)), pa.int64()), batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(terms, kind)], names=["row", "doc_id", "n", "terms"])
            row += len(sizes)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))
    return materialize(rows.mapInArrow(run, "row bigint, doc_id bigint, n bigint, terms array<struct<term: string, tf: bigint>>").filter(F.col("n") > 0), "scanned")


def _asked(items: DataFrame) -> DataFrame:
    """item, item_id, term, its hash, and times of the terms of each item; written, so that item is fixed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        item = TaskContext.get().partitionId() << 33
        for batch in slices(batches):
            rows = []
            for item_id, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                rows += [(item, item_id, w.decode("utf-8", "replace"), np.uint64(xxhash.xxh64_intdigest(w)).astype(np.int64).item(), n) for w, n in _counted(text).items()]
                item += 1
            columns = list(zip(*rows, strict=True)) or [[] for _ in range(5)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()], strict=True)], names=["item", "item_id", "term", "hash", "times"])

    rows = items.select(F.col("item_id").cast("bigint").alias("item_id"), text_or_empty().alias("text")).distinct()
    return materialize(rows.mapInArrow(run, "item bigint, item_id bigint, term string, hash bigint, times bigint"), "asked")


class TieredIndex:
    """Postings by tier of the terms that items ask for, and the residual bounds of each term."""

    def __init__(self, docs: DataFrame, asked: DataFrame):
        scanned = _scanned(docs, filter_bits(asked.select("hash").distinct()))
        n_docs, n_terms = scanned.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        length = f"(75 + ((25 * n * {n_docs}) div {max(n_terms, 1)}))"
        found = scanned.select("row", "doc_id", "n", F.inline("terms"))
        gained = found.withColumn("impact", F.expr(f"(1000000000 * tf) div (1000 * tf + 12 * {length})")).select("term", "row", "doc_id", "impact")
        weight = F.floor(1000 * F.log((2 * F.lit(float(n_docs)) + 2) / (2 * F.col("df") + 1)))
        terms = gained.groupBy("term").agg(F.count("*").alias("df"), F.max("impact").alias("most")).join(asked.select("term").distinct(), "term")
        terms = materialize(terms.withColumn("weight", weight).withColumn("most", F.col("weight") * F.col("most")).filter("weight > 0"), "terms")
        size, postings_n, greatest = terms.agg(F.count("*"), F.sum("df"), F.max("most")).first()
        with_terms = gained.join(F.broadcast(terms.drop("df")), "term") if size <= BROADCAST_ROWS else joined(gained, terms, "term", "df", postings_n)
        gain = F.col("weight") * F.col("impact")
        drawn = F.pow(gain.cast("double") * F.pow(F.col("most").cast("double"), F.lit(DRAWN)), F.lit(1 / (1 + DRAWN)))
        tier = sum((F.when(drawn < share * (greatest or 0), 1).otherwise(0) for share in TIERS), F.lit(0))
        #: term, row, doc_id, gain, tier
        self.postings = materialize(with_terms.select("term", "row", "doc_id", gain.alias("gain"), tier.alias("tier")), "postings", by=("tier",))
        #: term and below0, below1, ...: the greatest gain below each tier
        bounds = [F.coalesce(F.max(F.when(F.col("tier") > k, F.col("gain"))), F.lit(0)).alias(f"below{k}") for k in range(len(TIERS) + 1)]
        self.bounds = materialize(self.postings.groupBy("term").agg(*bounds), "bounds")


def _asking(postings: DataFrame, asked: DataFrame) -> DataFrame:
    """Postings with each item that asks for their term, by a broadcast if its size allows it."""
    if asked.count() <= BROADCAST_ROWS:
        return postings.join(F.broadcast(asked), "term")
    return dealt_join(postings, asked, "term", F.xxhash64("row"))


def _completed(index: TieredIndex, sums: DataFrame, asked: DataFrame, tier: int) -> DataFrame:
    """Exact scores of (item, row, doc_id, score) whose scores cover the tiers down to ``tier``."""
    below = asked.join(index.bounds.filter(F.col(f"below{tier}") > 0).select("term"), "term", "left_semi").select("item", "term", "times")
    missing = sums.select("item", "row").join(F.broadcast(below) if below.count() <= BROADCAST_ROWS else below, "item")
    more = index.postings.filter(F.col("tier") > tier).join(missing, ["row", "term"]).groupBy("item", "row").agg(F.sum(F.col("gain") * F.col("times")).alias("more"))
    return sums.join(more, ["item", "row"], "left").select("item", "row", "doc_id", (F.col("score") + F.coalesce("more", F.lit(0))).alias("score"))


def _best(scores: DataFrame, top: int) -> DataFrame:
    """The best of each item with their rank; Spark keeps only so many of an item in each task before it shuffles."""
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "row")
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id and score of the ``top`` best documents with a score for each item."""
    names = _asked(items)
    index = TieredIndex(docs, names)
    asked = materialize(names.join(index.bounds.select("term"), "term", "left_semi").select("item", "term", "times"), "terms-asked")
    rest = [F.sum(F.col(f"below{k}") * F.col("times")).alias(f"rest{k}") for k in range(len(TIERS) + 1)]
    open_items = materialize(asked.join(index.bounds, "term").groupBy("item").agg(*rest), "items")
    sums, exact = None, []
    for tier in range(len(TIERS) + 1):
        left = asked.join(open_items, "item", "left_semi")
        more = _asking(index.postings.filter(F.col("tier") == tier), left).select("item", "row", "doc_id", (F.col("gain") * F.col("times")).alias("score"))
        more = more if sums is None else sums.join(open_items.select("item"), "item", "left_semi").unionByName(more)
        sums = materialize(more.groupBy("item", "row", "doc_id").agg(F.sum("score").alias("score")), "sums")
        if tier == len(TIERS):
            exact.append(sums)
            break
        probes = _completed(index, materialize(_best(sums, top).drop("rank"), "probes"), left, tier)
        thresholds = probes.groupBy("item").agg(F.min("score").alias("least"), F.count("*").alias("n")).filter(F.col("n") == top).drop("n")
        judged = materialize(open_items.join(thresholds, "item", "left").withColumn("proven", F.coalesce(F.col(f"rest{tier}") < F.col("least"), F.lit(False))), "judged")
        proven = judged.filter("proven").select("item", "least", F.col(f"rest{tier}").alias("rest"))
        likely = sums.join(proven, "item").filter(F.col("score") + F.col("rest") >= F.col("least")).select("item", "row", "doc_id", "score")
        exact.append(_best(_completed(index, materialize(likely, "likely"), left, tier), top).drop("rank"))
        open_items = judged.filter("NOT proven").drop("least", "proven")
        if open_items.isEmpty():
            break
    scores = exact[0]
    for one in exact[1:]:
        scores = scores.unionByName(one)
    return _best(scores, top).join(names.select("item", "item_id").distinct(), "item").select("item_id", "rank", "doc_id", "score")


#: DuckDB's form: all scores, by the terms that items have.
ORACLE = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents WHERE text IS NOT NULL),
sizes AS (SELECT row, doc_id, len(w)::BIGINT AS n FROM d WHERE len(w) > 0),
total AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM sizes),
asked AS (SELECT item_id, term, count(*)::BIGINT AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark WHERE text IS NOT NULL) GROUP BY ALL),
tf AS (SELECT row, term, count(*)::BIGINT AS tf FROM (SELECT row, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * (SELECT docs FROM total) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM tf GROUP BY term),
gains AS (SELECT tf.row, doc_id, term, weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms))) AS gain FROM tf JOIN sizes USING (row) JOIN weights USING (term), total),
scores AS (SELECT item_id, row, doc_id, sum(gain * times)::BIGINT AS score FROM gains JOIN asked USING (term) GROUP BY ALL),
best AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM best WHERE rank <= 20
"""
