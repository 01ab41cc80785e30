"""Cases of the review of round 4 that failed before."""

import random

import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from tidemark.llm import token_counts
from tidemark.plans import link_queries

BYTE = public_tokenizers.path("byte_bpe_50k.json")


def words(rnd, n):
    return " ".join("".join(rnd.choices("abcdefghijklmnopqrstuvwxyzé", k=rnd.randrange(1, 14))) for _ in range(n))


def test_rows_of_frequencies_are_bounded_and_their_counts_are_those_of_the_library(spark):
    """Before, a row was a block of 16 million characters, and a task held as many as it read or wrote at a time."""
    rnd, tok = random.Random(7), Tokenizer.from_file(BYTE)
    texts = [words(rnd, 9000) for _ in range(12)] + ["", None, "é" * 300_000, "the end", "the end"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    rows = token_counts.frequencies(docs, BYTE, 12).collect()
    assert len(rows) > 3 and len({r.block for r in rows}) == len(rows)
    assert all(sum(map(len, r.tokens)) <= (1 << 18) + max(map(len, r.tokens)) for r in rows)
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, BYTE).collect()}
    assert got == {i: len(tok.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}


def test_pre_tokens_of_a_batch_are_counted_in_steps(monkeypatch):
    """Before, all that came in a batch of 64 MB was tokenised in one call."""
    rnd, given = random.Random(8), []

    class Counting:
        def __init__(self):
            self.tokenizer = Tokenizer.from_file(BYTE)

        def encode_batch_fast(self, texts, **options):
            given.append(len(texts))
            return self.tokenizer.encode_batch_fast(texts, **options)

    monkeypatch.setattr(token_counts, "_tokenizer", lambda path: Counting())
    rows = [{"bucket": i // 20, "block": i, "at": 0, "tokens": words(rnd, 4000).split()} for i in range(40)]

    class Rows:
        def mapInArrow(self, run, schema):
            return [x for b in run(iter([pa.RecordBatch.from_pylist(rows)])) for x in b.to_pylist()]

    got, tok = token_counts.piece_counts(Rows(), BYTE), Tokenizer.from_file(BYTE)
    assert max(given) < 40_000 < sum(given)
    assert [r["block"] for r in got] == [*range(40)] and all(r["pieces"] == [len(e) for e in tok.encode_batch(x["tokens"], add_special_tokens=False)] for r, x in zip(got, rows, strict=True))


def test_templates_of_turns_hold_their_ends(spark, tmp_path):
    """Before, the first 8,192 characters and 40 tokens of a turn were read, and turns that begin alike were one."""
    long = "".join(random.Random(9).choices(["north ", "quiet ", "river ", "stone "], k=200_000))
    fifty = " ".join(f"{a}{b}" for a in "abcde" for b in "klmnopqrst")
    texts = [f"{long}red", f"{long}blue", f"{fifty} red", f"{fifty} blue", "short one"]
    rows = [(1, turn, "user", text) for turn, text in enumerate(texts)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.text: (r.template_id, r.template) for r in link_queries.QUERIES["l1_templates"](spark, str(tmp_path)).collect()}
    assert got == {
        texts[0]: ("user:T00001", f"{long}<*>"), texts[1]: ("user:T00001", f"{long}<*>"),
        texts[2]: ("user:T00002", f"{fifty} <*>"), texts[3]: ("user:T00002", f"{fifty} <*>"), "short one": ("user:T00003", "short one"),
    }
