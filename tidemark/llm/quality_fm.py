"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A document's features are its words (in lower case, hashed into ``WORD_SLOTS``, the counts of a slot summed, damped, and
of unit length together), the bins of its
structure statistics and the bins of its metadata columns.  The score is the logistic of

    bias + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)

whose last term is the sum of all pairwise interactions <v_i, v_j> x_i x_j in time linear in the features.

Labels, language, source and doc_id are never features.  The machine is fitted on at most ``SAMPLE_ROWS`` labelled
documents, those of the least hashes of their ids; every document is scored over its whole text.

Defined results: a null text is an empty text; an empty text has a score from its statistics; a null in a metadata column
has a bin of its own; rows with a null doc_id or label are not learned from, but scored; equal texts and metadata have
equal scores; very long texts are read whole; of rows that share a doc_id one is learned from, the same in each run; without labelled rows the score is 0.5; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import frame_slices

WORD_SLOTS, RANK = 1 << 15, 8
#: Labelled documents that the machine is fitted on, at most.
SAMPLE_ROWS = 8000
EPOCHS, BATCH, RATE, DECAY, SEED = 6, 64, 0.05, 1e-4, 7
#: Bins of a statistic, besides those of nulls.
BINS = 10
METADATA = ("n_chars",)

STATISTICS = ("words", "word_length", "upper", "digit", "symbol", "exclaim", "other_punct", "high_bytes", "distinct", "top_word", "lines", "repeated_lines", "ends_plain")
_UPPER, _DIGIT = bytes(range(65, 91)), bytes(range(48, 58))
_SYMBOL, _EXCLAIM, _PUNCT = b"#*$%&|<>", b"!", b"\"'()+,-./:;=?@[\\]^_`{}~"
_HIGH = bytes(range(128, 256))


def structure(raw: bytes, words: list[bytes], counts: Counter) -> list[float]:
    """The values of ``STATISTICS`` of a text in UTF-8."""
    n_words, n_chars = max(len(words), 1), max(sum(map(len, words)), 1)
    share = lambda chars: (len(raw) - len(raw.translate(None, chars))) / n_chars
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n_lines = max(len(lines), 1)
    top = max(counts.values(), default=0)
    plain = sum(w[-1:].isalnum() or w[-1] > 127 or w[-1:] in b".," for w in words)
    return [np.log1p(len(words)), n_chars / n_words, *map(share, (_UPPER, _DIGIT, _SYMBOL, _EXCLAIM, _PUNCT, _HIGH)), len(counts) / n_words, top / n_words, n_lines / n_words, 1 - len({*lines}) / n_lines, plain / n_words]


def words_of(raw: bytes) -> tuple[list[bytes], Counter]:
    words = raw.split()
    return words, Counter(words)


def word_features(counts: Counter) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values of the words; the values have unit length together."""
    hashed = np.array([zlib.crc32(w.lower()) for w in counts], np.int64) % WORD_SLOTS
    # words of one slot, be it by case or by chance, are one feature: their counts add up before they are damped
    slots, at = np.unique(hashed, return_inverse=True)
    values = np.log1p(np.bincount(at, np.array(list(counts.values()), np.float64), len(slots)).astype(np.float32))
    return slots, values / max(float(np.sqrt((values * values).sum())), 1e-9)


class Machine:
    """Bins and weights: slots of words, then bins of statistics and of metadata, each with one more for nulls."""

    def __init__(self, edges: np.ndarray):
        self.edges = edges  # a row of ascending edges for each statistic and metadata column
        self.n = WORD_SLOTS + len(edges) * (BINS + 1)
        rng = np.random.default_rng(SEED)
        self.bias, self.w = 0.0, np.zeros(self.n, np.float32)
        self.v = rng.normal(0, 0.02, (self.n, RANK)).astype(np.float32)

    def bins(self, stats: np.ndarray) -> np.ndarray:
        """Slots of rows of statistics."""
        out = np.empty(stats.shape, np.int64)
        for i, edges in enumerate(self.edges):
            at = np.searchsorted(edges, stats[:, i], side="right")
            out[:, i] = WORD_SLOTS + i * (BINS + 1) + np.where(np.isnan(stats[:, i]), BINS, at)
        return out

    def raw_scores(self, slots: np.ndarray, values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores before the logistic, and the sums of v x, of documents whose features begin at ``starts``."""
        vx = self.v[slots] * values[:, None]
        sums = np.add.reduceat(vx, starts)
        squares = np.add.reduceat(vx * vx, starts)
        linear = np.add.reduceat(self.w[slots] * values, starts)
        return self.bias + linear + 0.5 * (sums * sums - squares).sum(axis=1), sums

    def fit(self, docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> None:
        """Stochastic gradients of the logistic loss with AdaGrad steps."""
        rng = np.random.default_rng(SEED)
        share = float(labels.mean())
        self.bias = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
        grown_w, grown_v = np.full(self.n, 1e-6, np.float32), np.full((self.n, RANK), 1e-6, np.float32)
        # the rarer class weighs as much as the other
        weight = np.where(labels == 1, 0.5 / max(share, 1e-6), 0.5 / max(1 - share, 1e-6)) if 0 < share < 1 else np.ones(len(labels))
        for _ in range(EPOCHS):
            for chosen in np.array_split(rng.permutation(len(docs)), max(1, len(docs) // BATCH)):
                sizes = np.array([len(docs[i][0]) for i in chosen])
                slots, values = (np.concatenate([docs[i][k] for i in chosen]) for k in (0, 1))
                starts = np.cumsum(sizes) - sizes
                raw, sums = self.raw_scores(slots, values, starts)
                error = ((1 / (1 + np.exp(-raw)) - labels[chosen]) * weight[chosen] / len(chosen)).astype(np.float32)
                self.bias -= RATE * float(error.sum())
                each = np.repeat(error, sizes)
                own, at = np.unique(slots, return_inverse=True)
                gw, gv = np.zeros(len(own), np.float32), np.zeros((len(own), RANK), np.float32)
                np.add.at(gw, at, each * values)
                np.add.at(gv, at, (each * values)[:, None] * (np.repeat(sums, sizes, axis=0) - self.v[slots] * values[:, None]))
                gw += DECAY * self.w[own]
                gv += DECAY * self.v[own]
                grown_w[own] += gw * gw
                grown_v[own] += gv * gv
                self.w[own] -= RATE * gw / np.sqrt(grown_w[own])
                self.v[own] -= RATE * gv / np.sqrt(grown_v[own])


def _features(text: str | None, metadata: list[float | None]) -> tuple[np.ndarray, np.ndarray, list[float]]:
    raw = (text or "").encode()
    words, counts = words_of(raw)
    meta = [np.nan if x is None or x != x else float(np.log1p(max(x, 0))) for x in metadata]
    return *word_features(counts), structure(raw, words, counts) + meta


def held_out(doc_id: Column) -> Column:
    """Whether a document's label is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, metadata: tuple[str, ...] = METADATA, sample_rows: int = SAMPLE_ROWS) -> Machine | None:
    """A machine fitted on at most ``sample_rows`` labelled documents that aren't held out; None without any."""
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.max("quality").alias("_label"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    # sample_rows ids at most: a bounded table
    rows = docs.select("doc_id", "text", *metadata).join(F.broadcast(chosen), "doc_id")
    # of several rows with one doc_id, the least by the hash of what is learned from
    row = F.struct(F.xxhash64("text", *metadata).alias("_hash"), "_label", "text", *metadata)
    rows = rows.groupBy("doc_id").agg(F.min(row).alias("_row")).select("doc_id", "_row.*")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frame_slices(frames):
            made = [_features(r[0], list(r[1:])) for r in frame[["text", *metadata]].itertuples(index=False)]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "label": frame["_label"], "slots": [x[0].astype("<u2").tobytes() for x in made], "vals": [x[1].astype("<f4").tobytes() for x in made], "stats": [x[2] for x in made]})

    got = rows.mapInPandas(run, "doc_id bigint, label int, slots binary, vals binary, stats array<double>").toPandas()
    if got.empty:
        return None
    got = got.sort_values("doc_id")  # the same machine whatever the order of arrival
    stats = np.stack(got["stats"].to_list())
    machine = Machine(np.nanquantile(stats, np.arange(1, BINS) / BINS, axis=0).T if len(stats) else np.zeros((stats.shape[1], BINS - 1)))
    docs_ = [(np.concatenate([np.frombuffer(s, "<u2").astype(np.int64), b]), np.concatenate([np.frombuffer(v, "<f4"), np.ones(len(b), np.float32)])) for s, v, b in zip(got["slots"], got["vals"], machine.bins(stats), strict=True)]
    machine.fit(docs_, got["label"].to_numpy(np.float32))
    return machine


def score_quality(docs: DataFrame, machine: Machine | None, metadata: tuple[str, ...] = METADATA) -> DataFrame:
    """doc_id, held_out, score and predicted of each document."""
    # the weights have a fixed size: slots times (rank + 1) floats
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for frame in frame_slices(frames):
            if own is None:
                yield pd.DataFrame({"doc_id": frame["doc_id"], "held_out": frame["held_out"], "score": 0.5})
                continue
            scores = np.zeros(len(frame))
            for lo in range(0, len(frame), 128):
                made = [_features(r[0], list(r[1:])) for r in frame[["text", *metadata]].iloc[lo : lo + 128].itertuples(index=False)]
                bins = own.bins(np.array([x[2] for x in made]))
                slots = np.concatenate([np.concatenate([m[0], b]) for m, b in zip(made, bins, strict=True)])
                values = np.concatenate([np.concatenate([m[1], np.ones(len(b), np.float32)]) for m, b in zip(made, bins, strict=True)]).astype(np.float32)
                sizes = np.array([len(m[0]) + bins.shape[1] for m in made])
                raw, _ = own.raw_scores(slots, values, np.cumsum(sizes) - sizes)
                scores[lo : lo + 128] = 1 / (1 + np.exp(-np.clip(raw.astype(np.float64), -50, 50)))
            yield pd.DataFrame({"doc_id": frame["doc_id"], "held_out": frame["held_out"], "score": scores})

    ids = F.col("doc_id").cast("bigint")
    rows = docs.select(ids.alias("doc_id"), held_out(ids).alias("held_out"), "text", *metadata)
    scored = rows.mapInPandas(run, "doc_id bigint, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def quality_scores(docs: DataFrame, labels: DataFrame, metadata: tuple[str, ...] = METADATA) -> DataFrame:
    return score_quality(docs, fit_quality(docs, labels, metadata), metadata)
