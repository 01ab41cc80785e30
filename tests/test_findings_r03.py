"""Cases of the review of round 3 that failed before."""

import datetime
import functools
import operator
import random

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa

from tidemark.llm import token_store
from tidemark.operators import links as K
from tidemark.operators import templates as M
from tidemark.operators import vectors
from tidemark.operators import views as V
from tidemark.plans import lab_queries, link_queries


def test_a_period_that_begins_with_the_last_tick_touches_no_hour(spark, tmp_path):
    """The last two ticks are high, so the key warms at the very end."""
    start = datetime.datetime(2024, 1, 1)
    each = [(h, 12 if h >= 70 or h in (30, 31, 32, 33) else 1) for h in range(72)]
    rows = [(start + datetime.timedelta(hours=h, minutes=i), 3) for h, n in each for i in range(n)]
    events = pd.DataFrame({"event_id": range(len(rows)), "ts": [r[0] for r in rows], "user_id": [r[1] for r in rows], "event_type": "error", "value": 1.0, "props": '{"k": 1}'})
    events["ts"] = events["ts"].astype("datetime64[us]")
    events.to_parquet(tmp_path / "events.parquet")
    got = lab_queries.QUERIES["d8_hours_touched"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    want = con.execute(lab_queries.ORACLES["d8_hours_touched"]).fetchall()
    periods = lab_queries._periods(spark, str(tmp_path)).filter("end = start").count()
    assert periods > 0 and want and sorted(map(tuple, got.collect())) == sorted(want)


def test_a_rate_that_equals_its_mean_has_no_excess(spark):
    """The mean of six equal rates, summed in doubles, can be less than they are."""
    day = datetime.date(2024, 1, 3)
    # sum() would compensate
    tied = [k for k in range(1, 60) if functools.reduce(operator.add, [k / 360] * 6) / 6 < k / 360]
    rows = [("s", f"s:{k}", day, h, k if h == 0 else 0, 60, k / 360) for k in [*tied, 30] for h in range(6)]
    rows += [("s", "s:up", day, h, 7 if h == 0 else 0, 60, 6.9 / 360) for h in range(6)]
    cell = spark.createDataFrame(rows, "service string, key string, day date, hour int, sum long, n_minutes long, mean double")
    asked = spark.createDataFrame([("s", day, 0, 6)], "service string, day date, hour_from int, hour_to int")
    first = spark.createDataFrame([], "service string, key string, day date, hour int")
    assert tied and [(r["rank"], r["key"]) for r in V.contributors(cell, asked, first).collect()] == [(1, "s:up")]


class EachTemplate:
    """A leaf that compares each list with each template, in Python."""

    def __init__(self):
        self.templates = []

    def add(self, tokens):
        best = (-1.0, -1, 0)
        for i, own in enumerate(self.templates):
            same = sum(a == b for a, b in zip(own, tokens, strict=True) if a != M.WILD) / max(len(tokens), 1)
            best = max(best, (same, own.count(M.WILD), -i))
        if self.templates and best[0] >= M.SIMILARITY:
            at = -best[2]
            self.templates[at] = [a if a == b else M.WILD for a, b in zip(self.templates[at], tokens, strict=True)]
            return at
        self.templates.append(tokens)
        return len(self.templates) - 1


def test_blocks_of_a_leaf_find_what_comparing_all_does():
    rnd = random.Random(3)
    for length in (0, 1, 2, 3, 5, 8, 17, 40):
        for words in (["a", "b", M.WILD], [f"w{i}" for i in range(40)] + [M.WILD]):
            lists = [rnd.choices(words, k=length) for _ in range(30)]
            lists += [[t if rnd.random() < keep else rnd.choice(words) for t in rnd.choice(lists)] for keep in (0.5, 0.65, 0.8) for _ in range(150)]
            leaf, each = M.Leaf(), EachTemplate()
            assert [leaf.add([*x]) for x in lists] == [each.add([*x]) for x in lists] and leaf.templates == each.templates


def test_a_leaf_of_many_templates_does_not_compare_all():
    """Lists that share no block with most templates are compared with few of them."""
    rnd, leaf, seen = random.Random(4), M.Leaf(), []
    near = leaf._near
    leaf._near = lambda own: seen.append(near(own)) or seen[-1]
    for _ in range(3000):
        leaf.add([f"w{rnd.randrange(500)}" for _ in range(40)])
    assert sum(map(len, seen)) < 3000 * 3000 / 100


def shuffled(spark, df):
    """Rows that stages of ``df`` write to shuffles, and its rows."""
    sc = spark.sparkContext

    def rows():
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = rows()
    out = df().collect()
    return rows() - before, out


def test_vectors_without_clusters_are_not_sent_to_each_cell(spark):
    """A row goes to each slab or block, of which a table has a bounded number, and not to each of 256 cells."""
    x = np.random.default_rng(5).normal(size=(2500, 24)).astype(np.float32)
    table = spark.createDataFrame([("s", i, v.tolist()) for i, v in enumerate(x)], "service string, id long, embedding array<float>").cache()
    n, found = shuffled(spark, lambda: vectors.CellIndex(table, ["service"]).matches(table, 18.0))
    sim = x.astype(np.float64) @ x.astype(np.float64).T
    np.fill_diagonal(sim, -np.inf)
    assert {(r.id, r.other) for r in found} == {(int(i), int(j)) for i, j in zip(*np.nonzero(sim >= 18.0), strict=True)} and found
    assert n < 2500 * 2 * (vectors.SPLIT + 1)


def test_best_line_of_each_document(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 50)
    monkeypatch.setattr(vectors, "STRIP", 300)
    x = np.random.default_rng(6).normal(size=(700, 8)).astype(np.float32)
    rows = [("a" if i % 3 else "b", i, v.tolist(), f"d{i % 5}") for i, v in enumerate(x)]
    table = spark.createDataFrame(rows, "class string, id long, embedding array<float>, doc string").cache()
    asked, lines = table.filter("id % 4 <> 0"), table.filter("id % 4 = 0")
    sim, want = x.astype(np.float64) @ x.astype(np.float64).T, {}
    for i in range(700):
        for j in range(0, 700, 4):
            if i % 4 and bool(i % 3) == bool(j % 3):
                want[i, f"d{j % 5}"] = max(want.get((i, f"d{j % 5}"), -np.inf), sim[i, j])
    n, got = shuffled(spark, lambda: K.best_by_doc(asked, lines, ["class"]))
    assert {(r.id, r.doc) for r in got} == want.keys() and all(abs(r.sim - want[r.id, r.doc]) < 1e-9 for r in got)
    high = {p for p, s in want.items() if s >= 2.0}
    assert {(r.id, r.doc) for r in K.best_by_doc(asked, lines, ["class"], 2.0).collect()} == high and 0 < len(high) < len(want)


def test_similarities_are_rounded_once(spark, tmp_path):
    """0.3457944999 has six places of its own, though nine places of it would round up."""
    a = np.float32(0.345794)
    b = np.float32(0.3457944999 - float(a))
    rows = [(3, 0, [1.0, 1.0]), (30, 0, [float(a), float(b)]), (60, 0, [-1.0, 0.0])]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.execute(link_queries.ORACLES["l3_j6_inherited"]).fetchall()
    assert sorted(map(tuple, link_queries.QUERIES["l3_j6_inherited"](spark, str(tmp_path)).collect())) == want == [(3, 30, 0.345794)]


def test_words_of_one_wording_are_tokenised_once(spark):
    """Capitals don't make new words where the tokenizer makes them small, but for its special strings."""
    path = public_tokenizers.path("word_bpe_49k.json")
    table = token_store.WordTable(path)
    texts = ["The the THE end", "<|ENDOFTEXT|> The <|endoftext|>The", "", "Á İ İ ΣAΣ it's IT'S", " 　x y\x1c"]
    want = [table.tokenizer.encode(t, add_special_tokens=False).ids + [1] for t in texts]
    ids, counts = table.encode(texts, 1)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want
    few = token_store.WordTable(path)
    few.encode(texts[:1], 1)
    assert len(few.known) == 3  # the end id's, the, end


def test_letters_are_tokenised_once_whatever_signs_follow(spark):
    """Before, each of these words was new to the tokenizer."""
    path, given = public_tokenizers.path("word_bpe_49k.json"), []

    class Spy:
        def __init__(self, inner):
            self.inner = inner

        def encode(self, words, **how):
            given.extend(words)
            return self.inner.encode(words, **how)

        def encode_batch_fast(self, texts, **how):
            given.extend(w for t in texts for w in t.split(" "))
            return self.inner.encode_batch_fast(texts, **how)

    table = token_store.WordTable(path)
    table.tokenizer, whole = Spy(table.tokenizer), table.tokenizer
    text = "Reathe reathe, reathe. reathe;$$ reathe, it's it'"
    ids, counts = table.encode([text], 1)
    assert given.count("reathe") == 1 and not any(w.startswith("reathe") and w != "reathe" for w in given)
    assert ids.tolist() == whole.encode(text, add_special_tokens=False).ids + [1] and counts.tolist() == [len(ids)]


def test_ids_of_odd_words_are_the_tokenizers(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    table, rng = token_store.WordTable(path), random.Random(5)
    parts = [*"aBzÉéßİıǅŉ÷×ñ,.;:!$#\'\"([-0917 \t\n", "the", "lamente", "'s", "'LL", "e\u0301", "\u0338", "=", "Σ", "中文", "한", "\u1112\u1161", "😀", "\u00a0", "\u2028", "ﬁ", "\x1c", "\x85", "  ", "<|endoftext|>", "<|EndOfText|>", "<|", "x|>"]
    texts = ["", " ", "\n a \n", *("".join(rng.choices(parts, k=rng.randrange(1, 30))) for _ in range(3000))]
    want = [table.tokenizer.encode(t, add_special_tokens=False).ids + [1] for t in texts]
    for at in range(0, len(texts), 500):
        ids, counts = table.encode(texts[at : at + 500], 1)
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want[at : at + 500]
    assert table.encode([], 1)[1].tolist() == []


def test_runs_of_a_batch_keep_its_rows(monkeypatch):
    monkeypatch.setattr(token_store, "RUN_BYTES", 10)
    texts = ["", "a" * 25, None, "b" * 4, "c" * 4, "d" * 4, None, "e" * 11]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(texts)], names=["doc_id", "text"])
    for at in range(9):
        runs = [r.column(1).to_pylist() for r in token_store._runs(batch.slice(at))]
        assert sum(runs, []) == texts[at:] and all(sum(len(x or "") for x in r[1:]) <= 10 for r in runs)
