"""Each operator against a brute-force version, and over nulls, empty and long texts, ties, repeated rows and no rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("public_tokenizers")

import public_tokenizers
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import _spark, bloom, bpe, licenses, media, mixing, pii, quality_fm, quality_rules, simhash, token_counts, token_store

DATA = "/root/testdata/sf0.001"
BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
WORDS = re.compile("[^\x20\x09-\x0d]+")

#: Names of columns that the operators make for themselves.
CLASHES = ("size", "key", "fp", "language", "digest", "target", "added", "row", "whole", "hash", "kept", "n_words", "n", "root", "taken", "finish", "upto", "_words", "_size", "_fp", "_of", "_part", "_sum", "_classes", "js_words", "component_id", "spans")

EDGES = [
    (None, None, None, None, None),
    (None, "<|endoftext|> hi\x1cthere", "en", None, 3),
    (900001, "", "en", "src0", 0),
    (900002, " \n\t ", "xx", "src1", 5),
    (900003, "Of the word " * 9000, "en", "src0", 1),
    (900004, "é́漢字 \U0001f600 ###", "fr", "srcé", 7),
    (900005, "mail a@b@c.de or x.y+z@mail.example.com, 1.2.3.4 and 999.1.1.1, 4111 1111-1111 1111, +1 (555) 123-4567", "en", "src2", 2),
    (900006, "same text twice", "en", "src0", 1),
    (900006, "same text twice", "en", "src0", 1),
    (900007, "same text twice", "en", "src0", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    own = spark.read.parquet(f"{DATA}/documents.parquet")
    df = own.unionByName(spark.createDataFrame(EDGES, own.schema))
    # columns whose names clash with those that operators make
    return df.withColumns({c: F.concat(F.lit(f"{c} "), F.col("source")) for c in CLASHES}).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return docs.collect()


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def passed_through(got, docs, but=()):
    """Each row of ``got`` is one of ``docs``, in all columns but some."""
    assert got.columns == docs.columns
    left = [c for c in docs.columns if c not in but]
    known = {tuple(r[c] for c in left) for r in docs.collect()}
    assert all(tuple(r[c] for c in left) in known for r in got.collect())


def same(got, want):
    order = lambda x: sorted(map(repr, x))
    assert order(map(tuple, got)) == order(want)


def test_quality_rules(docs, rows, none):
    got = quality_rules.quality_rules(docs).collect()
    want = []
    for r in rows:
        w = WORDS.findall(r.text or "")
        grams = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {i + k for i in range(len(w) - 2) for k in range(3) if grams[tuple(w[i : i + 3])] > 1}
        lines = [x for x in (r.text or "").split("\n") if WORDS.search(x)]
        want.append((r.doc_id, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", r.text or "")), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 2 * len(covered) > len(w)))
    same([tuple(x)[:7] for x in got], want)
    assert not any(x.kept and x.base_failed for x in got)
    assert sum(x.kept for x in got) > 100
    assert quality_rules.quality_rules(none).count() == 0
    kept = quality_rules.kept_documents(docs)
    passed_through(kept, docs)
    assert kept.count() == sum(x.kept for x in got) and quality_rules.kept_documents(none).count() == 0


def test_languages_without_reference_are_judged_by_their_classes(spark):
    import string

    random.seed(8)
    plain = lambda letters: " ".join("".join(random.choice(letters) for _ in range(random.randint(3, 9))) + random.choice(["", "", "", "", "", "", "", ",", "."]) for _ in range(300))
    known = [" ".join(random.choice(["the", "of", "and", "house", "river", "walks", "slowly", "Green"]) + random.choice(["", "", "", "", "", "", "", ",", "."]) for _ in range(400)) for _ in range(20)]
    texts = [plain("абвгдежзийклмно"), plain("qxzwvjk" + string.ascii_lowercase), " ".join(f"{plain('abc')[:4]}%%% ###" for _ in range(100))]
    docs = spark.createDataFrame(list(enumerate(texts + known)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs).collect()}
    assert [got[i].language for i in range(3)] == [None] * 3 and got[5].language == "en"
    assert not any(got[i].base_failed for i in range(2)) and got[0].kept and got[1].kept and not got[2].kept


def test_quality_rules_on_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality_rules.quality_rules(docs).join(labels, "doc_id").filter("NOT base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept"))
    share = {r.quality: r.kept for r in got.collect()}
    assert share[1] > 0.98 and share[0] < 0.2


def test_quality_machine(spark, docs, none):
    all_docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    machine = quality_fm.fit_quality(all_docs, labels)
    got = quality_fm.score_quality(all_docs, machine).join(labels, "doc_id").filter("held_out").collect()
    assert len(got) > 50 and np.mean([r.predicted == r.quality for r in got]) > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    scored = quality_fm.score_quality(docs, machine).collect()
    assert len(scored) == docs.count() and all(0 <= r.score <= 1 for r in scored)
    assert quality_fm.score_quality(none, machine).count() == 0
    assert quality_fm.fit_quality(all_docs, labels.limit(0)) is None
    assert {r.score for r in quality_fm.score_quality(docs, None).collect()} == {0.5}
    # scores over all pairs of features, each made by hand
    texts = {r.doc_id: r for r in all_docs.limit(40).collect()}
    for r in quality_fm.score_quality(all_docs.limit(40), machine).collect():
        assert r.score == pytest.approx(slow_score(machine, texts[r.doc_id].text, texts[r.doc_id].n_chars), abs=1e-3)


def slow_score(machine, text, n_chars):
    words = (text or "").encode().split()
    slots = collections.Counter(zlib.crc32(w.lower()) % quality_fm.WORD_SLOTS for w in words)
    length = sum(np.log1p(c) ** 2 for c in slots.values()) ** 0.5
    x = {s: np.log1p(c) / max(length, 1e-9) for s, c in slots.items()}
    stats = [*quality_fm.structure((text or "").encode(), words, collections.Counter(words)), np.log1p(n_chars)]
    for i, (v, edges) in enumerate(zip(stats, machine.edges, strict=True)):
        x[quality_fm.WORD_SLOTS + i * (quality_fm.BINS + 1) + sum(v >= e for e in edges)] = 1.0
    items = list(x.items())
    raw = machine.bias + sum(machine.w[s] * v for s, v in items)
    vs = np.array([machine.v[s].astype(float) * v for s, v in items])
    pairs = vs @ vs.T
    return 1 / (1 + np.exp(-(raw + np.triu(pairs, 1).sum())))


def test_words_of_one_slot_are_one_feature():
    slots, values = quality_fm.word_features(collections.Counter([b"The", b"the", b"THE", b"cat"]))
    assert len(slots) == 2 == len({*slots.tolist()})
    assert sorted((values / values.min()).tolist()) == pytest.approx([1, np.log1p(3) / np.log1p(1)])


def test_machine_is_linear_time_form_of_all_pairs():
    rng = np.random.default_rng(1)
    machine = quality_fm.Machine(np.zeros((1, quality_fm.BINS - 1)))
    machine.w = rng.normal(size=machine.n).astype(np.float32)
    slots, x = rng.integers(0, machine.n, 12), rng.normal(size=12).astype(np.float32)
    pairs = sum(float(machine.v[slots[i]] @ machine.v[slots[j]]) * x[i] * x[j] for i in range(12) for j in range(i))
    raw, _ = machine.raw_scores(slots, x, np.array([0]))
    assert raw[0] == pytest.approx(float(machine.w[slots] @ x) + pairs, abs=1e-4)


def test_mix(docs, rows, none):
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(rows)
    sizes = collections.Counter()
    for r in rows:
        sizes[r.source] += len(WORDS.findall(r.text or ""))
    order = sorted((s for s in sizes if s is not None), key=lambda s: s) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    # fill by hand
    target, total, open_ = {}, sum(sizes.values()), set(order)
    while open_:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] >= 3 * sizes[s]}
        if not full:
            target |= share
            break
        target |= {s: 3.0 * sizes[s] for s in full}
        open_ -= full
    taken, longest, source = collections.Counter(), collections.Counter(), {}
    for r in rows:
        source[r.doc_id] = r.source if r.doc_id is not None else None
        n = len(WORDS.findall(r.text or ""))
        longest[r.source] = max(longest[r.source], n)
    for r in got:
        assert r.taken <= 3 * r["size"]
        if r.doc_id is not None:
            s = source[r.doc_id]
            assert r.target == pytest.approx(target[s]) and r.source_size == sizes[s]
            taken[s] += r.taken
    for s in order:
        if s is not None:
            assert abs(taken[s] - target[s]) <= 2 * max(longest.values())
    assert sum(r.taken for r in got) <= total
    same(map(tuple, mixing.mix_sources(docs).collect()), map(tuple, got))
    out = mixing.mixed(docs)
    passed_through(out, docs)
    assert out.count() == sum(r.copies for r in got)
    same(((r.doc_id, len(WORDS.findall(r.text or ""))) for r in out.collect()), [(r.doc_id, r["size"]) for r in got for _ in range(r.copies)])
    assert mixing.mix_sources(none).count() == 0 and mixing.mixed(none).count() == 0


def test_mix_of_repeated_rows_holds_its_budget(spark):
    own = spark.read.parquet(f"{DATA}/documents.parquet")
    one = own.orderBy("doc_id").limit(1)
    docs = own.unionByName(one.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(40)))).drop("i")).repartition(5).cache()
    got, out = mixing.mix_sources(docs).collect(), mixing.mixed(docs).collect()
    size = lambda r: len(WORDS.findall(r.text or ""))
    budget = sum(map(size, docs.collect()))
    assert len(out) == sum(r.copies for r in got) and sum(map(size, out)) == sum(r.taken for r in got) <= budget
    assert sum(r.taken for r in got) > budget - 2 * max(map(size, docs.collect()))


def slow_fingerprint(text):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = WORDS.findall(w)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(fps, k=4):
    up = {f: f for f in fps}

    def root(f):
        while up[f] != f:
            f = up[f]
        return f

    fps = sorted(set(fps))
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= k:
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {f: root(f) for f in fps}


def test_simhash(docs, rows, none):
    got = simhash.near_duplicates(docs).collect()
    fps = {}
    for r in rows:
        fps.setdefault(r.text, slow_fingerprint(r.text))
    root = slow_components(list(fps.values()))
    least = {}
    for r in rows:
        if r.doc_id is not None:
            c = root[fps[r.text]]
            least[c] = min(least.get(c, r.doc_id), r.doc_id)
    same(got, [(r.doc_id, f"{fps[r.text]:016x}", least.get(root[fps[r.text]])) for r in rows])
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.representatives(docs)
    passed_through(kept, docs)
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(least.values())


def test_index_prunes(spark):
    rng = np.random.default_rng(2)
    fps = rng.integers(0, 2**63, 20000).astype(np.uint64)
    rows = len(fps)
    found = simhash.search(np.zeros(rows, int), np.zeros(rows, int), fps, 4)
    found.run()
    assert found.compared < rows * (rows - 1) // 4 and found.pruned > 0 and found.pairs == 0
    # one whole top node: the same links as by brute force
    near = [f ^ (1 << int(b)) for f in fps[:300].tolist() for b in rng.integers(0, 64, 2)]
    few = np.unique(np.concatenate([fps[:300], np.array(near, np.uint64)]))
    found = simhash.search(np.zeros(len(few), int), np.zeros(len(few), int), few, 4)
    label, want = found.run(), slow_components(few.tolist())
    groups = collections.defaultdict(set)
    for f, at in zip(found.fps.tolist(), label.tolist(), strict=True):
        groups[at].add(f)
    expected = collections.defaultdict(set)
    for f, r in want.items():
        expected[r].add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_masks_hold_each_link():
    rng = np.random.default_rng(9)
    assert [simhash.shared_blocks(n) for n in (0, 10**6, 10**8, 10**12)] == sorted(simhash.shared_blocks(n) for n in (0, 10**6, 10**8, 10**12))
    for shared in (1, 2, 3):
        own = simhash.masks(4, shared)
        for _ in range(300):
            off = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
            assert any(off & m == 0 for m in own)


@pytest.mark.parametrize("n", [10**5, 10**6])
def test_masks_leave_few_comparisons(n):
    rng = np.random.default_rng(3)
    fps = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
    compared = []
    for m in simhash.masks(4, simhash.shared_blocks(len(fps)))[:3]:
        bits = fps & np.uint64(m)
        order = np.argsort(bits, kind="stable")
        found = simhash.search(bits[order], np.zeros(len(fps), int), fps[order], 4)
        found.run()
        compared.append(found.compared)
    all_masks = sum(compared) / 3 * len(simhash.masks(4, simhash.shared_blocks(len(fps))))
    # pairs under masks of one block, expected
    plain = sum(n * n / 2 / 2 ** m.bit_count() for m in simhash.masks(4, 1))
    assert all_masks < plain / 30
    assert all_masks < simhash.MEMBERS * n


def test_lone_fingerprints_meet_nobody():
    fps = np.array([1, 2, 3, 2**60], np.uint64)
    found = simhash.search(np.arange(4), np.zeros(4, int), fps, 4)
    assert len(found.run()) == 0 and found.compared == 0
    found = simhash.search(np.array([1, 1, 2, 3]), np.zeros(4, int), fps, 4)
    assert found.run().tolist() == [0, 0]


@pytest.mark.parametrize("hot, shared", [(8192, 1), (60, 1), (8192, 3), (60, 2)])
def test_links_of_dense_groups(spark, monkeypatch, hot, shared):
    monkeypatch.setattr(simhash, "shared_blocks", lambda *_: shared)
    rng = np.random.default_rng(3)
    fps = [int(x) for x in rng.integers(0, 2**62, 150)]
    for x in fps[:60]:
        for _ in range(5):
            for b in rng.integers(0, 64, rng.integers(1, 5)):
                x ^= 1 << int(b)
            fps.append(x)
    fps += [fps[100] ^ (1 << i) ^ (1 << j) for i in range(24) for j in range(i)]  # all within four bits of each other
    want = slow_components(fps)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in set(fps)]
    found = simhash.links(spark.createDataFrame(signed, "fp bigint"), hot=hot)
    assert found.count() < 20 * len(fps)  # forests, not all pairs
    roots = {r.node % 2**64: r.root % 2**64 for r in simhash.components(found).collect()}
    groups = collections.defaultdict(set)
    for f in set(fps):
        groups[roots.get(f, f)].add(f)
    expected = collections.defaultdict(set)
    for f, r in want.items():
        expected[r].add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_personal_spans(docs, rows, none):
    got = pii.personal_spans(docs).collect()
    digits = lambda s: re.sub("[^0-9]", "", s)

    def base(t):
        return {
            "email": [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)],
            "ip": [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))],
            "card": [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))],
            "phone": [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15],
        }

    random.seed(4)
    for _ in range(3000):
        t = "".join(random.choice("a1.2@+- ()b%_9é") for _ in range(random.randint(0, 40)))
        assert base(t) == pii.base_spans(t), t
    want = []
    for r in rows:
        spans = base(r.text or "")
        named = ",".join(f"{k}:{a}:{b}" for k, own in spans.items() for a, b in own)
        want.append((r.doc_id, *map(len, spans.values()), hashlib.sha256(named.encode()).hexdigest()))
    same([tuple(r)[:6] for r in got], want)
    assert pii.personal_spans(none).count() == 0
    clean = pii.sanitised(docs)
    passed_through(clean, docs, but=("text", "n_chars"))
    assert clean.count() == len(rows) and all(r.n_chars == (None if r.text is None else len(r.text)) for r in clean.collect())
    assert not any(sum(map(len, base(r.text or "").values())) for r in clean.collect())


def test_revealing_terms(spark):
    text = "Filler before it\n{0}aa mister Zorblatt writes jane.doe@example.com daily {0}bb end"
    own = [(i, text.format("bcdef"[i]), "en", "s", 1) for i in range(5)]
    own += [(10 + i, f"plain words daily number {'xyzuvw'[i]}{'abc'[i % 3]}", "en", "s", 1) for i in range(6)]
    own += [(20, "the name Zorblatt alone", "en", "s", 1)]
    docs = spark.createDataFrame(own, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    spans = {r.doc_id: r.spans for r in pii.personal_spans(docs).collect()}
    words = {i: {t[int(a) : int(b)] for k, a, b in (s.split(":") for s in spans[i].split(",") if s) if k.split("-")[0] in ("general", "removed")} for i, t, *_ in own}
    assert {"mister", "writes"} <= words[0] and "daily" not in words[0] and not words[10]
    assert pii.disclosure(1000, 5, 5, 5) == pytest.approx(1) and pii.disclosure(1000, 50, 5, 5) < 0.6


def test_rare_entities_disclosed_by_their_groups(spark):
    # each address stands in one text only; the word that gives it away is on the line above, and short
    own = [(i, f"Filler {'bcdef'[i]}{'mnpqr'[i]}\nab Qi\n{'vwxyz'[i]}one{i}@corp{i}.example.org {'ghjkl'[i]}{'x' * 450} cut", "en", "s", 1) for i in range(5)]
    own += [(10 + i, f"plain words number {'xyzuvw'[i]}{'abc'[i % 3]}", "en", "s", 1) for i in range(6)]
    docs = spark.createDataFrame(own, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    spans = {r.doc_id: r.spans for r in pii.personal_spans(docs).collect()}
    words = {i: {t[int(a) : int(b)] for k, a, b in (s.split(":") for s in spans[i].split(",") if s) if k.split("-")[0] in ("general", "removed")} for i, t, *_ in own}
    assert all({"ab", "Qi", "cut"} <= words[i] for i in range(5)) and not any(words[10 + i] for i in range(6))
    text = "x " * 300 + "Ann\n\nLee <a.b@c.de>, " + "y" * 500 + " Bo Cy 10.0.0.7"
    entities, near = pii._near(text, pii.base_spans(text))
    assert {"email", "email:@c.de", "ip", "ip:10.0.0"} < {*entities} and len(entities) == 6
    assert {t for e, t in near if e == "email"} == {"ann", "lee", "y" * 500, "bo"} and {t for e, t in near if e == "ip"} == {"y" * 500, "bo", "cy"}


def test_copies_of_a_text_count_once(spark):
    own = [f"only {i} here" for i in range(2000)]
    own += ["kontakt eva@one.example.com copied"] * 200 + [f"kontakt eva@one.example.com {w}" for w in ("aa", "bb")] + [f"kontakt without {w}" for w in "cdefghijkl"]
    own += [f"zorbl tom@two.example.com {w}" for w in ("mm", "nn", "oo")] + ["zorbl without any, copied"] * 200
    docs = spark.createDataFrame(list(enumerate(own)), "doc_id bigint, text string").repartition(7)
    found = pii.materialize(pii.find_base(docs), "test")
    terms = {r.term for r in pii.revealing_terms(docs, found).collect()}
    texts = set(own)
    has = lambda w: sum(w in t for t in texts)
    assert pii.disclosure(len(texts), has("kontakt"), 3, 3) < 0.9 < pii.disclosure(len(texts), has("zorbl"), 3, 3)
    assert terms == {"zorbl"}
    words = {"kontakt", "zorbl", "without", "copied", "only", "here"}
    bits = bloom.bloom_of(spark.createDataFrame([(w,) for w in words], "term string"))
    copied = bloom.bloom_of(spark.createDataFrame([(hashlib.sha256(t.encode()).digest(),) for t, c in collections.Counter(own).items() if c > 1], "digest binary"))
    got = {r.term: r.n_t for r in pii._term_counts(docs, bits, copied).collect()}
    assert {w: got[w] for w in words} == {w: sum(w in re.findall("[a-z]+", t) for t in texts) for w in words}


def test_terms_outside_of_spans():
    random.seed(6)
    for _ in range(500):
        text = "".join(random.choice("abİß 1@.") for _ in range(60))
        spans = sorted((a, a + random.randint(1, 9)) for a in random.sample(range(60), 6))
        sought = set(random.sample(sorted(pii.terms_of(text)), len(pii.terms_of(text)) // 2))
        want = collections.defaultdict(list)
        for m in pii._TERM.finditer(text):
            if m[0].lower() in sought and not any(a < m.end() and m.start() < b for a, b in spans):
                want[m[0].lower()].append(f"{m.start()}:{m.end()}")
        assert pii.outside(text, sought, spans) == want


def test_bloom_filter(spark):
    keys = [f"word{i}" for i in range(20000)]
    found = bloom.bloom_of(spark.createDataFrame([(k,) for k in keys], "k string"))
    assert found.bits >= bloom.BITS_EACH * len(keys) and all(k in found for k in keys)
    assert sum(f"other{i}" in found for i in range(20000)) < 400
    assert "x" not in bloom.bloom_of(spark.createDataFrame([], "k string"))


def test_token_store(docs, rows, none, spark):
    tok = Tokenizer.from_file(WORD)
    ids = {t: tok.encode(t or "", add_special_tokens=False).ids + [1] for t in {r.text for r in rows}}
    got = token_store.token_store(docs, WORD).orderBy("start").collect()
    same([(r.doc_id, r.n_tokens, r.ids_crc32) for r in got], [(r.doc_id, len(ids[r.text]), zlib.crc32(np.array(ids[r.text], "<u4").tobytes())) for r in rows])
    at, known = 0, [r.doc_id for r in got if r.doc_id is not None]
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert known == sorted(known)
    dictionary = token_store.train_dictionary(docs, WORD, 1)
    store = token_store.write_store(docs, WORD, dictionary)
    first = next(r for r in rows if r.doc_id == 3)
    assert token_store.read_document(store, dictionary, 3) == [ids[first.text]]
    with pytest.raises(Exception, match="needs dictionary"):
        token_store.read_store(store, dictionary + b"x").collect()
    assert token_store.token_store(none, WORD).count() == 0


def test_dictionary_learns_from_long_documents(spark):
    long = " ".join(f"w{i % 977}x" for i in range(40000))
    assert len(long) > 131072 + 12
    docs = spark.createDataFrame([(i, long[i:]) for i in range(12)], "doc_id bigint, text string")
    assert token_store.train_dictionary(docs, WORD, 1)
    assert token_store.train_dictionary(docs.limit(0), WORD, 1) == b""


def test_token_counts(docs, rows, none):
    tok = Tokenizer.from_file(BYTE)
    n = {t: len(tok.encode(t or "", add_special_tokens=False).ids) for t in {r.text for r in rows}}
    same(token_counts.token_counts(docs, BYTE).collect(), [(r.doc_id, len((r.text or "").encode()), n[r.text], n[r.text] > 512) for r in rows])
    assert token_counts.token_counts(none, BYTE).count() == 0


def test_each_distinct_pre_token_is_counted_once(spark, docs, monkeypatch):
    monkeypatch.setattr(token_counts, "BLOCK_CHARS", 5000)
    blocks = token_counts.frequencies(docs, BYTE, 12).collect()
    places = [(b, r.block, r.cuts[i], r.tokens[r.cuts[i] : r.cuts[i + 1]]) for r in blocks for i, b in enumerate(r.buckets)]
    distinct = {t for *_, tokens in places for t in tokens}
    assert len(distinct) < sum(len(tokens) for *_, tokens in places)
    counted = []

    class Counting:
        def __init__(self, tokenizer):
            self.tokenizer = tokenizer

        def encode_batch_fast(self, texts, **options):
            counted.extend(texts)
            return self.tokenizer.encode_batch_fast(texts, **options)

    # the function that tasks run, over batches that cut buckets apart
    monkeypatch.setattr(token_counts, "_tokenizer", lambda path: Counting(Tokenizer.from_file(path)))

    class Rows:
        def mapInArrow(self, run, schema):
            rows = sorted(places)
            batches = [pa.RecordBatch.from_pylist([dict(zip(("bucket", "block", "at", "tokens"), x, strict=True)) for x in rows[i : i + 7]]) for i in range(0, len(rows), 7)]
            return [x for b in run(iter(batches)) for x in b.to_pylist()]

    got = token_counts.piece_counts(Rows(), BYTE)
    assert sorted(counted) == sorted(distinct)
    tok, tokens = Tokenizer.from_file(BYTE), {(block, at): own for _, block, at, own in places}
    for r in got:
        assert r["pieces"] == [len(tok.encode(t, add_special_tokens=False).ids) for t in tokens[r["block"], r["at"]]]


def test_bpe(docs, rows, none):
    tok = Tokenizer.from_file(BYTE)

    def want(r):
        ids = tok.encode(r.text or "", add_special_tokens=False).ids
        back = tok.decode(ids, skip_special_tokens=False)
        return r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()

    same(bpe.bpe_round_trip(docs, BYTE).collect(), map(want, rows))
    assert bpe.bpe_round_trip(none, BYTE).count() == 0
    one = bpe.with_ids(docs, BYTE).filter("doc_id = 900003").first()
    assert one.decoded == "Of the word " * 9000 and one.ids == tok.encode(one.decoded, add_special_tokens=False).ids


def test_bpe_of_odd_characters():
    encoder, tok = bpe.Encoder(BYTE), Tokenizer.from_file(BYTE)
    points = [*range(0, 0x3000), *range(0xA000, 0xA400), *range(0x1F300, 0x1F700)]
    texts = [f"a{chr(c)}1 {chr(c)}{chr(c)} b" for c in points if not 0xD800 <= c < 0xE000] + ["x" * 5000, "ab" * 150000, " " * 700 + "a", "\n \n  b"]
    ids, counts = encoder.encode(texts)
    got = np.split(ids, np.cumsum(counts)[:-1])
    assert all(g.tolist() == e.ids for g, e in zip(got, tok.encode_batch(texts, add_special_tokens=False), strict=True))


def test_media(docs, rows, none):
    def want(r):
        raw = (r.text or "").encode()
        p = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        chunks = media.chunks_of(p)
        assert b"".join(chunks) == p
        digests = [media.digest_of(c) for c in chunks]
        form = media.stored_form(chunks, digests, [d in shared for d in digests])
        return r.doc_id, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(form), hashlib.sha256(form).hexdigest(), media.feature_of(p, len(chunks))

    shared = bloom.bloom_of(media.shared_digests(docs))
    same(media.media_columns(docs).collect(), map(want, rows))
    assert media.media_columns(none).count() == 0
    containers, chunks = media.write_media(docs)
    stored = {r.doc_id: r.media for r in containers.collect()}
    table = {bytes(r.digest): bytes(r.chunk) for r in chunks.collect()}
    assert any(s for m in stored.values() for *_, s in media.chunk_list(bytes(m))) and table
    assert media.payload_from(bytes(stored[900005]), table).startswith(b"mail a@b@c.de")
    one = bytes(stored[900004])
    with pytest.raises(ValueError, match="damaged"):
        media.payload_from(one[:-1] + b"!", table)


def test_gear_cuts_are_those_of_the_rolling_hash():
    random.seed(5)
    for n in (0, 100, 5000, 40000):
        p = media.payload_of(bytes(random.getrandbits(8) % 50 for _ in range(n)))
        h, start, ends = 0, 0, []
        for i, b in enumerate(p):
            h = (h * 2 + int(media._GEAR[b])) % 2**32
            if i + 1 - start >= media.MOST or i + 1 - start >= media.LEAST and h >> (32 - media.CUT_BITS) == 0:
                ends.append(i + 1)
                start = i + 1
        assert media.cut_ends(p) == ends + ([len(p)] if start < len(p) else [])


def slow_alignment(template, doc, low, high):
    """Best score of local alignments along the diagonals low to high, cell by cell."""
    score = collections.defaultdict(int)
    best = 0
    for i, word in enumerate(template):
        for at in range(max(0, i + low), min(len(doc), i + high + 1)):
            around = max(score[i - 1, at] if at - i < high else 0, score[i, at - 1] if at - i > low else 0)
            score[i, at] = max(0, score[i - 1, at - 1] + (2 if doc[at] == word else -1), around - 1)
            best = max(best, score[i, at])
    return best


def test_alignment_against_all_cells():
    rng = np.random.default_rng(4)
    for _ in range(150):
        template = rng.integers(0, 6, rng.integers(1, 30))
        docs = [rng.integers(-1, 6, rng.integers(0, 50)) for _ in range(4)]
        at = rng.integers(0, 4)
        docs[at] = np.concatenate([docs[at], np.delete(template, rng.integers(0, len(template))), docs[at]])
        ends = np.cumsum([len(d) for d in docs])
        starts = ends - [len(d) for d in docs]
        low = rng.integers(-20, 40, 4)
        high = low + rng.integers(0, 12, 4)
        n, first, end = licenses.aligned(template, np.concatenate([*docs, [-1]]), starts, ends, low, high)
        for d in range(4):
            best = slow_alignment(template.tolist(), docs[d].tolist(), int(low[d]), int(high[d]))
            assert (n[d] > 0) == (best > 0)
            if best:  # what is reported is an alignment of that score: n matches, all else costs a point
                span = slow_alignment(template.tolist(), docs[d][first[d] - starts[d] : end[d] + 1 - starts[d]].tolist(), -60, 60)
                assert span >= best and 2 * n[d] >= best and n[d] <= end[d] - first[d] + 1


def test_licenses(spark, docs, rows, none):
    templates = licenses.standard_templates()
    index = licenses.LicenseIndex(templates)
    assert {"GPL-3.0", "Apache-2.0", "MPL-2.0", "MIT", "BSD-3-Clause", "CC0-1.0"} < {*templates}
    for name, text in templates.items():
        (found,) = index.matches([f"wörter davor {text.upper()} and after"])
        assert found[0][0] == name and found[0][3] == 1 and found[0][4] == 13 + re.search("[A-Za-z0-9]", text).start(), name
    words = templates["MIT"].split()
    del words[10]
    words.insert(30, "really")
    ((match,),) = index.matches(["x y " + " ".join(words)])
    assert match[0] == "MIT" and 0.95 < match[3] < 1
    # a long text with words lost and added all along
    words = templates["GPL-2.0"].split()
    edited = [w for i, w in enumerate(words) if i % 50] + ["end"]
    edited = [x for i, w in enumerate(edited) for x in ([w, "added"] if i % 60 == 0 else [w])]
    assert index.matches([" ".join(edited)])[0][0][0] == "GPL-2.0"
    # notices end to end are as many matches
    for name, notice in licenses.NOTICES.items():
        text = f"{notice} {notice}\n{notice}"
        (found,) = index.matches([text])
        assert [m[0] for m in found] == [name] * 3, name
        assert [text[m[4] : m[5]] for m in found] == [notice.rstrip(".")] * 3 or name.startswith(("MPL", "Apache-2.0-h"))
    data = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in data.collect()}
    got = {(r.doc_id, r.template, texts[r.doc_id][r.start : r.end] + ".") for r in licenses.license_matches(data).collect()}
    planted = {"MIT-notice": "Released under the MIT License.", "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.", "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.", "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3."}
    assert got == {(i, name, n) for i, t in texts.items() for name, n in planted.items() if n in t}
    # all templates against all diagonals of the texts, without fingerprints
    small = {i: t for i, t in texts.items() if len(t.split()) < 120}
    for i, t in list(small.items())[:60]:
        codes = np.array([index.vocabulary.get(w, -1) for w in licenses.words_of(t)], np.int64)
        for name, own in zip(index.names, index.codes, strict=True):
            if len(own) < 60 and len(codes):
                n, *_ = licenses.aligned(own, np.append(codes, -1), np.array([0]), np.array([len(codes)]), np.array([-len(own)]), np.array([len(codes)]))
                assert (n[0] >= licenses.COVERAGE * len(own)) <= any(g[0] == i for g in got), (i, name)
    assert licenses.license_matches(none).count() == 0 and licenses.license_matches(docs, {}).count() == 0
    edge = {r.doc_id for r in licenses.license_matches(docs).collect()}
    assert edge == {r.doc_id for r in rows if any(n in (r.text or "") for n in planted.values())}


def slow_mix(rows):
    """The copies of (doc_id, source, text) rows that the mix takes, one after the other."""
    size = lambda r: len(WORDS.findall(r[2] or ""))
    sources = sorted({r[1] for r in rows if r[1] is not None}) + [None] * any(r[1] is None for r in rows)
    total = {s: sum(size(r) for r in rows if r[1] == s) for s in sources}
    weight, target, open_ = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}, {}, set(sources)
    while open_:
        left = sum(total.values()) - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] >= 3 * total[s]}
        target |= {s: 3.0 * total[s] for s in full} if full else share
        open_ = open_ - full if full else set()
    copies = []
    for s in sources:
        upto = 0
        for r in sorted((r for r in rows if r[1] == s), key=lambda r: hashlib.md5(f"{'' if r[0] is None else r[0]}:{r[2] or ''}".encode()).hexdigest()):
            upto += size(r)
            copies += [((e * total[s] + upto) / target[s], e, r) for e in range(3) if size(r)]
    out, done = [], 0
    for _, _, r in sorted(copies, key=lambda c: c[0]):
        done += size(r)
        if done > sum(total.values()):
            break
        out.append(r)
    return out


def test_mix_against_a_queue(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "source", "text").collect()]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    same(mixing.mixed(docs).collect(), slow_mix(rows))


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r.doc_id for r in quality_rules.quality_rules(docs).collect() if r.kept}
    left = [r for r in docs.collect() if r.doc_id in kept]
    fps = {r.doc_id: slow_fingerprint(r.text) for r in left}
    root, least = slow_components(list(fps.values())), {}
    for i, f in fps.items():
        least[root[f]] = min(i, least.get(root[f], i))
    single = [r for r in left if r.doc_id in {*least.values()}]
    # no term of this corpus discloses an entity, so the patterns alone are replaced
    clean = [(r.doc_id, r.source, pii.replaced(r.text, [(a, b, k) for k, own in pii.base_spans(r.text).items() for a, b in own])) for r in single]
    tok, want = Tokenizer.from_file(BYTE), []
    for i, _, text in slow_mix(clean):
        ids = tok.encode(text, add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    same(corpus_pipeline.run(spark, sf).collect(), want)


def test_scratch_deletes_what_was_written_in_it(spark):
    import os

    with _spark.scratch(spark):
        lost = _spark.materialize(spark.range(3).toDF("x"), "lost")
        held = _spark.materialize(lost.selectExpr("x + 1 AS x"), "held", keep=True)
        (path,) = {os.path.dirname(f) for f in lost.inputFiles()}
    assert sorted(r.x for r in held.collect()) == [1, 2, 3] and not os.path.exists(path.removeprefix("file://"))
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000"
