"""Decontamination, conversation repair and lexical search against plain versions, over edge cases and skewed data."""

import collections
import hashlib
import heapq
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import conversations, decontamination, lexical, words

DATA = "/root/testdata/sf0.001"
TERMS = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}
DOCS = "doc_id long, text string, item_id string, row string, hits string, n string, at string"
PASSAGE = "the quick brown fox jumps over the lazy dog while eleven more words follow here"


def of(text):
    return TERMS.findall((text or "").translate(LOWER))


def edge_docs():
    rnd = random.Random(3)
    some = [" ".join(rnd.choices("alpha beta Gamma delta the of é漢 x1 y2 z3 w4 v5".split(), k=rnd.randrange(0, 60))) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(some)]
    rows += [(100, None), (None, PASSAGE), (101, ""), (102, " ,.!\n"), (103, "X " * 500_000 + PASSAGE + " y" * 10), (104, "q" * 1_200_000), (105, PASSAGE.upper()), (105, PASSAGE.upper()), (106, PASSAGE.replace("lazy", "tired"))]
    rows += [(200 + i, f"start {i} {PASSAGE} end") for i in range(1500)]  # a passage that a third and more share
    return [(i, t, "7", "r", "h", "n", "a") for i, t in rows]


ITEMS = [("1", PASSAGE), ("2", "Alpha, BETA"), ("3", "漢"), ("4", ""), ("5", None), (None, "x1 y2"), ("1", "lazy dog"), ("6", "over " + PASSAGE[4:]), ("7", "never seen anywhere at all"), ("8", PASSAGE + " and then some"), ("2", "Alpha, BETA")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(edge_docs(), DOCS).repartition(6).cache()


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(i, t, "w") for i, t in ITEMS], "item_id string, text string, before string").cache()


def contaminated(text, windows):
    own, hit, found = of(text), set(), set()
    for n, table in windows.items():
        for p in range(len(own) - n + 1):
            if ids := table.get(tuple(own[p : p + n])):
                hit |= set(range(p, p + n))
                found |= ids - {None}
    named = sorted(found)
    return len(own), len(hit), len(named), hashlib.sha256(",".join(named).encode()).hexdigest(), bool(hit)


def windows_of(items):
    out = collections.defaultdict(lambda: collections.defaultdict(set))
    for i, text in items:
        w = of(text)
        n = min(len(w), 10)
        for p in range(len(w) - n + 1 if w else 0):
            out[n][tuple(w[p : p + n])].add(i)
    return out


def test_decontamination(docs, items):
    windows = windows_of(ITEMS)
    got = collections.Counter(tuple(r) for r in decontamination.contamination(docs, items).collect())
    assert got == collections.Counter((r.doc_id, *contaminated(r.text, windows)) for r in docs.collect())


def test_decontamination_of_nothing(docs, items):
    assert decontamination.contamination(docs.limit(0), items).collect() == []
    rows = decontamination.contamination(docs, items.limit(0)).collect()
    assert len(rows) == docs.count() and not any(r.contaminated or r.n_hit for r in rows)


def test_shared_spans(docs, items):
    got = {(r.item_id, r.start, r.end) for r in decontamination.shared_spans(docs, items).filter("doc_id = 106").collect()}
    n = len(of(PASSAGE))
    assert got == set()  # seven and seven words agree around another one
    got = {(r.item_id, r.start, r.end) for r in decontamination.shared_spans(docs, items).filter("doc_id = 103").collect()}
    assert min(s for _, s, _ in got) == 500_000 and max(e for _, _, e in got) == 500_000 + n
    assert {i for i, _, _ in got} == {"1", "6", "8"}


def test_every_shared_window_leaves_a_fingerprint():
    rnd = random.Random(1)
    for _ in range(200):
        shared = [f"w{rnd.randrange(50)}" for _ in range(decontamination.WINDOW)]
        kept = []
        for _ in range(2):
            before, after = ([f"v{rnd.randrange(9)}" for _ in range(rnd.randrange(20))] for _ in range(2))
            codes = words.word_hashes(" ".join(before + shared + after))
            grams = words.gram_hashes(codes, decontamination.GRAM)
            kept.append({(int(grams[p]), int(p) - len(before)) for p in decontamination.winnowed(grams) if 0 <= p - len(before) <= decontamination.LEFT})
        assert kept[0] & kept[1]


def test_dealt_join(spark):
    many = spark.range(6000).select((F.col("id") % 7 * (F.col("id") % 2)).alias("k"), F.col("id").alias("v"))
    one = spark.createDataFrame([(0, "a"), (0, "b"), (1, "c"), (9, "d")], "k long, w string")
    assert sorted(words.dealt_join(many, one, "k", F.xxhash64("v")).collect()) == sorted(many.join(one, "k").collect())


# conversations


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def plain_repair(rows):
    """Cheapest, then ASCII-least edits by a search over (rows used, last role)."""
    heap, done = [(0, "", 0, "n", ())], set()
    while True:
        cost, audit, i, last, text = heapq.heappop(heap)
        if (i, last) in done:
            continue
        done.add((i, last))
        if i == len(rows) and last in "na":
            return cost, audit, hashlib.sha256("\n".join(text).encode()).hexdigest()
        to, name = ("a", "assistant") if last == "u" else ("u", "user")
        heapq.heappush(heap, (cost + 3, audit + "I", i, to, (*text, f"{name}:")))
        if i == len(rows):
            continue
        role, own, fault = rows[i]
        heapq.heappush(heap, (cost + 4, audit + "D", i + 1, last, text))
        if fault in ("blank", "duplicate"):
            continue
        more = 3 * (fault == "truncated")
        if role[:1] == to:
            heapq.heappush(heap, (cost + more, audit + "K", i + 1, to, (*text, f"{role}:{own}")))
        if role[:1] == "s" and last == "n":
            heapq.heappush(heap, (cost + more, audit + "K", i + 1, "s", (*text, f"{role}:{own}")))
        heapq.heappush(heap, (cost + more + 3, audit + "R", i + 1, to, (*text, f"{name}:{own}")))


def plain_conversation(rows):
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    seen, faulty, counts = set(), [], collections.Counter()
    for _, _, role, text in rows:
        held = re.sub("[\x20\x09-\x0d]", "", text)
        fault = "blank" if not held else "duplicate" if (role, text) in seen else "" if held[-1] in ".!?" else "truncated"
        seen.add((role, text))
        counts[fault] += 1
        faulty.append((role, text, fault))
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, *plain_repair(faulty))


def plain_conversations(rows):
    by = collections.defaultdict(list)
    for r in plain_damage(rows):
        by[r[0]].append(r)
    return {conv: plain_conversation(by[conv]) for conv in {r[0] for r in rows}}


def odd_conversations():
    rnd = random.Random(7)
    rows = []
    for conv in range(300):
        for _ in range(rnd.randrange(1, 9)):
            rows.append((conv, rnd.choice([None, *range(6)]), rnd.choice(["user", "assistant", "system", None, "", "ubot", "other"]), rnd.choice(["Yes.", "no", "What?", None, "", " \t", "é!", "Yes. "])))
    rows += [(None, 1, "user", "Hi."), (None, 2, "assistant", "Ho!"), (None, None, None, None)]
    rows += [(900, t, "user", "again and again.") for t in range(400)] + [(901, 1, "user", "z" * 1_200_000), (901, 2, "assistant", "Long enough. " * 90_000)]
    return rows + rows[:40]


@pytest.mark.parametrize("which", ["odd", "table"])
def test_conversations(spark, which):
    if which == "odd":
        rows = odd_conversations()
        df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, fault string").repartition(5)
    else:
        df = spark.read.parquet(f"{DATA}/conversations.parquet")
        rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    got = conversations.conversation_repairs(df).collect()
    assert {r.conv_id: tuple(r)[1:] for r in got} == plain_conversations(rows) and len(got) == len({r[0] for r in rows})
    turns = collections.defaultdict(list)
    for r in conversations.repaired_turns(conversations.damaged(df)).orderBy("conv_id", "place").collect():
        turns[r.conv_id].append(r)
    for r in got:
        own = turns[r.conv_id]
        assert hashlib.sha256("\n".join(f"{t.role}:{t.text}" for t in own).encode()).hexdigest() == r.repaired_sha256
        assert re.fullmatch("(s?(ua)+)?", "".join(t.role[0] for t in own)) and "".join(t.edit for t in own) == r.audit.replace("D", "")


def test_conversations_are_dealt_once(spark):
    df = conversations.conversation_repairs(spark.read.parquet(f"{DATA}/conversations.parquet"))
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(conv_id") == 1
    assert conversations.conversation_repairs(spark.read.parquet(f"{DATA}/conversations.parquet").limit(0)).collect() == []


def test_repairs_against_a_search():
    rnd = random.Random(5)
    for _ in range(4000):
        rows = [(rnd.choice(["user", "assistant", "system", "user", "assistant", " ", "", "ug"]), str(rnd.randrange(4)), rnd.choice(["", "", "", "blank", "duplicate", "truncated"])) for _ in range(rnd.randrange(9))]
        repair = conversations.Repair()
        for row in rows:
            repair.add(*row)
        assert repair.end() == plain_repair(rows)


# search


def plain_ranked(docs, items, top=20):
    texts = [(i, of(t)) for i, t in docs]
    texts = [(i, w, collections.Counter(w)) for i, w in texts if w]
    n_docs, n_terms = len(texts), sum(len(w) for _, w, _ in texts)
    df = collections.Counter(t for _, _, c in texts for t in c)
    out = []
    for item, text in {(i, t or "") for i, t in items}:
        asked = collections.Counter(of(text))
        scores = []
        for i, w, c in texts:
            m = 75 + (25 * len(w) * n_docs) // n_terms
            s = sum(q * math.floor(1000 * math.log((2.0 * n_docs + 2) / (2.0 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t, q in asked.items() if t in c)
            scores.append((-s, i is None, i or 0, i))
        out += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scores)[:top], 1) if s[0]]
    return sorted(out, key=str)


@pytest.mark.parametrize("tiers", [lexical.TIERS, (0.9, 0.7, 0.5, 0.4, 0.3, 0.2)])
def test_ranked(docs, items, monkeypatch, tiers):
    monkeypatch.setattr(lexical, "TIERS", tiers)
    whole = docs.withColumn("term", F.lit("t")).withColumn("score", F.lit(1))
    own = [(None if i is None else int(i), t) for i, t in ITEMS]
    got = lexical.ranked(whole, items)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_ranked([(r.doc_id, r.text) for r in docs.collect()], own)


def test_ranked_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BROADCAST_ROWS", 0)
    docs, items = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "benchmark"))
    got = lexical.ranked(docs, items, top=5)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_ranked(docs.select("doc_id", "text").collect(), items.select("item_id", "text").collect(), 5)


def test_ranked_of_nothing(docs, items):
    assert lexical.ranked(docs.limit(0), items).collect() == [] and lexical.ranked(docs, items.limit(0)).collect() == []


def test_residual_bounds(spark):
    """No posting below a tier gains more than its term's bound, and upper tiers hold the lists of rare terms first."""
    docs, items = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "benchmark"))
    index = lexical.TieredIndex(docs, lexical._asked(items))
    both = index.postings.join(index.bounds, "term")
    for k in range(len(lexical.TIERS) + 1):
        assert both.filter(F.col("tier") > k).filter(F.col("gain") > F.col(f"below{k}")).isEmpty()
    often = {r.tier: r.n for r in index.postings.join(index.postings.groupBy("term").count(), "term").groupBy("tier").agg(F.avg("count").alias("n")).collect()}
    assert [often[t] for t in sorted(often)] == sorted(often.values())
