"""Texts of over a megabyte, words of over a megabyte, and what the license index finds of altered notices."""

import random
import time

import pytest

pytest.importorskip("public_tokenizers")

import public_tokenizers
from tokenizers import Tokenizer

from tidemark.llm import bpe, licenses

BYTE = public_tokenizers.path("byte_bpe_50k.json")
HEADER = licenses.NOTICES["GPL-3.0-header"]


def test_a_header_after_a_long_chain():
    index = licenses.LicenseIndex({"GPL-3.0-header": HEADER})
    phrase = " ".join(HEADER.split()[:5])
    for times in (2_000, 220_000):
        text = f"{phrase} " * times
        (name, n, size, _, start, end), = index.matches([text + HEADER])[0]
        assert (name, n, size) == ("GPL-3.0-header", 42, 42)
        assert (start, end) == (len(text), len(text) + len(HEADER) - 1)


def test_a_megabyte_of_one_phrase_takes_little():
    index = licenses.LicenseIndex(licenses.standard_templates())
    phrase = "GNU General Public License as published by the Free Software Foundation, "
    began = time.process_time()
    index.matches([phrase * (1_000_000 // len(phrase))])
    assert time.process_time() - began < 20


def test_copies_end_to_end_are_found_each():
    index = licenses.LicenseIndex({"h": HEADER})
    phrase = " ".join(HEADER.split()[:5]) + " "
    text = phrase * 60 + (HEADER + " " + phrase * 7) * 5 + phrase * 60
    got = index.matches([text])[0]
    starts = [i for i in range(len(text)) if text.startswith(HEADER, i)]
    assert [m[4] for m in got if m[1] == 42] == starts


def test_recall_of_altered_notices():
    """Of notices with 15 % and 25 % of their words replaced, at least nine of ten are found."""
    rnd = random.Random(9)
    index = licenses.LicenseIndex(licenses.standard_templates())
    texts, wanted = [], []
    for name, text in licenses.standard_templates().items():
        if len(words := text.split()) > 1500:
            continue
        for share in (0.15, 0.25):
            for _ in range(6):
                own = list(words)
                for i in rnd.sample(range(len(own)), int(share * len(own))):
                    own[i] = f"zz{rnd.randrange(999)}"
                texts.append(" ".join(["lorem"] * 30 + own + ["ipsum"] * 30))
                wanted.append(name)
    found = [{m[0] for m in own} for own in index.matches(texts)]
    assert sum(w in f for w, f in zip(wanted, found, strict=True)) >= 0.9 * len(wanted)


@pytest.mark.parametrize("word", ["x" * 1_500_000, "".join(random.Random(2).choices("etaoinshrdlu", k=1_200_000))])
def test_a_word_of_over_a_megabyte(word):
    began = time.process_time()
    ids, counts = bpe.Encoder(BYTE).encode([word])
    assert time.process_time() - began < 60
    assert bpe.encoder(BYTE).decode_bytes(ids)[0] == word.encode() and counts.tolist() == [len(ids)]


def test_long_words_have_the_librarys_ids():
    library = Tokenizer.from_file(BYTE)
    rnd = random.Random(4)
    for word in ("ab" * 30_000 + "x" * 3001, "".join(rnd.choices("etaoinshrdlué漢", k=40_000)), "a" * 4097):
        assert bpe.encoder(BYTE).encode([word])[0].tolist() == library.encode(word, add_special_tokens=False).ids


def test_merges_without_an_order_go_one_by_one():
    """With a merge that makes a part of an earlier one, only the leftmost pair is taken at each step."""
    one, other = bpe.Vocabulary(BYTE), bpe.Vocabulary(BYTE)
    other.ordered = False
    words = [x.encode() for x in ("banana bandana", "aaaaaaa", "x" * 200, "the quick brown fox")]
    (a, n), (b, m) = (bpe.encode_pre_tokens(v, words) for v in (one, other))
    assert one.ordered and a.tolist() == b.tolist() and n.tolist() == m.tolist()
