"""Personal data: patterns, and terms that reveal protected entities by their co-occurrence in the corpus.

The patterns find e-mail addresses, IPv4 addresses, payment card numbers and phone numbers; each distinct value is a
protected entity, and so is each of the groups that it is in, since few values recur: the domain of an address, the
network of an IP, the issuer of a card, the prefix of a phone number, and its kind.  A term discloses an entity when the
pointwise mutual information of the two comes near all that there is to know about the entity:

    PMI(term; entity) = log2(N n_te / (n_t n_e)),    IC(entity) = log2(N / n_e),    disclosure = PMI / IC

over N distinct texts, where n_e hold the entity, n_t the term, and n_te the term within ``CONTEXT`` words of the entity, on
whatever line.  Terms are words of two letters or more, in lower case.  Terms of disclosure ``THRESHOLD`` or more near an
entity of at least ``SUPPORT`` different texts are generalised (replaced by a label that names the kind of the entity that
they disclose most), those of ``REMOVE`` or more removed, in every document that has them.  All counts are over the whole
corpus; copies of a text count once.

The terms near entities go to the tasks as a Bloom filter, sized from their count up to a bound, which only saves work:
what passes is joined with the terms themselves.  So do the digests of texts that have copies: only the texts that pass
are brought together by digest before their terms are counted.

Defined results: a null text is an empty text; equal texts have equal spans, whatever their ids; null ids are kept; very
long texts are read whole; an empty table gives an empty result; other columns are ignored by ``personal_spans`` and kept by ``sanitised``, whatever
their names.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ._spark import frame_slices, materialize, text_or_empty, whole
from .bloom import Bloom, bloom_of

KINDS = ("email", "ip", "card", "phone")
CONTEXT, SUPPORT, THRESHOLD, REMOVE = 3, 3, 0.9, 0.999
#: Words that a worker remembers about the filter; beyond it the table starts anew.
KEEP = 400_000

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a search that fails at the first digit of a run fails at its other digits too: it need not begin there
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TERM = re.compile(r"[^\W\d_]{2,}")
_WORD = re.compile(r"\S+")

Span = tuple[int, int]


def emails(text: str) -> list[Span]:
    """Leftmost non-overlapping addresses, in time linear in the text: each has one @, and its local part runs up to it."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = done + len(text[done:at].rstrip(_LOCAL))
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
        done = m.end() if m else at + 1
        at = text.find("@", done)
    return out


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def luhn(digits: str) -> bool:
    twice = [int(d) * 2 for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in twice)) % 10 == 0


def base_spans(text: str) -> dict[str, list[Span]]:
    out = {k: [] for k in KINDS}
    if "@" in text:
        out["email"] = emails(text)
    if _DIGIT.search(text):
        out["ip"] = [m.span() for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out["card"].append(m.span())
        if "+" in text:
            out["phone"] = [m.span() for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def _named(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, own in spans.items() for a, b in own)


def _levels(kind: str, found: str) -> list[str]:
    """The value itself and the groups that it is in, from the narrowest to its kind."""
    if kind == "email":
        value = found.lower()
        group = value[value.index("@") :]
    elif kind == "ip":
        value = ".".join(part.lstrip("0") or "0" for part in found.split("."))
        group = value[: value.rindex(".")]
    else:
        value = re.sub("[^0-9]", "", found)
        group = value[:6] if kind == "card" else value[:-7]
    return [hashlib.blake2b(f"{kind}:{value}".encode(), digest_size=12).hexdigest(), f"{kind}:{group}", kind]


def _near(text: str, spans: dict[str, list[Span]]) -> tuple[list[str], list[tuple[str, str]]]:
    """The entities of a text, and the (entity, term) pairs of the terms within ``CONTEXT`` words of them."""
    words = [m.span() for m in _WORD.finditer(text)]
    starts, ends = [a for a, _ in words], [b for _, b in words]
    entities, out = set(), set()
    for kind, own in spans.items():
        for a, b in own:
            levels = _levels(kind, text[a:b])
            entities.update(levels)
            # what an entity leaves of the words that it is in counts as words before and after it
            i, j = bisect_left(starts, a), bisect_right(ends, b)
            near = [text[x : min(y, a)] for x, y in words[max(i - CONTEXT, 0) : i]] + [text[max(x, b) : y] for x, y in words[j : j + CONTEXT]]
            terms = {t.lower() for w in near for t in _TERM.findall(w)}
            out |= {(e, t) for e in levels for t in terms}
    return sorted(entities), sorted(out)


def find_base(docs: DataFrame) -> DataFrame:
    """doc_id, digest, counts by kind, base_sha256, base (the spans), entities and near ((entity, term) pairs) of each document."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frame_slices(frames):
            rows = []
            for text in frame["text"]:
                spans = base_spans(text)
                base = _named(spans)
                entities, near = _near(text, spans) if base else ([], [])
                rows.append((*(len(spans[k]) for k in KINDS), hashlib.sha256(base.encode()).hexdigest(), base, entities, [{"entity": e, "term": t} for e, t in near]))
            made = pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "entities", "near"])
            yield pd.concat([frame[["doc_id", "digest"]].reset_index(drop=True), made], axis=1)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), _digest().alias("digest"), text_or_empty().alias("text"))
    return rows.mapInPandas(run, "doc_id bigint, digest binary, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, base string, entities array<string>, near array<struct<entity:string,term:string>>")


def _digest():
    return F.unhex(F.sha2(text_or_empty().cast("binary"), 256))


def terms_of(text: str) -> set[str]:
    """The distinct terms of a text.  Each word is lowered by itself, as where its span is reported."""
    return {t.lower() for t in {*_TERM.findall(text)}}


class _Passes:
    """Which words the filter passes; remembers a bounded number of them."""

    def __init__(self, filter_: Bloom):
        self.filter, self.known = filter_, {}

    def __call__(self, words: set[str]) -> list[str]:
        known = self.known
        if len(known) > KEEP:
            known.clear()
        for w in words.difference(known):
            known[w] = w in self.filter
        return [w for w in words if known[w]]


def _term_counts(docs: DataFrame, sought: Bloom, copied: Bloom) -> DataFrame:
    """term and n_t (distinct texts that have it) of the words that the filter passes.

    Counted in each task first, but for texts whose digests pass the filter of those that have copies: each of these
    goes once by its digest, with its terms.
    """
    shared = docs.sparkSession.sparkContext.broadcast((sought, copied))  # a bounded number of bits

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sought, copied = shared.value
        passes, counts, seen = _Passes(sought), Counter(), set()
        table = lambda: pd.DataFrame({"copied": False, "key": [t.encode() for t in counts], "terms": list(counts), "n": list(counts.values())})
        for frame in frame_slices(frames):
            apart = []
            for digest, text in zip(frame["digest"], frame["text"], strict=True):
                if digest in seen:
                    continue
                terms = passes(terms_of(text))
                if digest not in copied:
                    counts.update(terms)
                    continue
                if len(seen) > KEEP:
                    seen.clear()
                seen.add(digest)
                apart.append((True, digest, " ".join(terms), 1))
            yield pd.DataFrame(apart, columns=["copied", "key", "terms", "n"])
            if len(counts) > KEEP:
                yield table()
                counts.clear()
        if counts:
            yield table()

    rows = docs.select(_digest().alias("digest"), text_or_empty().alias("text")).mapInPandas(run, "copied boolean, key binary, terms string, n bigint")
    each = rows.groupBy("copied", "key").agg(F.first("terms").alias("terms"), F.sum("n").alias("n"))
    each = each.filter("terms <> ''").select(F.explode(F.split("terms", " ")).alias("term"), F.when(F.col("copied"), 1).otherwise(F.col("n")).alias("n"))
    return each.groupBy("term").agg(F.sum("n").alias("n_t"))


def outside(text: str, sought: set[str], spans: list[Span]) -> dict[str, list[str]]:
    """Places (start:end) of the terms sought, but for those that touch a span; both are walked once, in order."""
    out: dict[str, list[str]] = {}
    spans, at = sorted(spans), 0
    reach = -1  # where the spans that begin before the term end
    for m in _TERM.finditer(text):
        while at < len(spans) and spans[at][0] < m.end():
            reach = max(reach, spans[at][1])
            at += 1
        if m.start() >= reach and (term := m[0].lower()) in sought:
            out.setdefault(term, []).append(f"{m.start()}:{m.end()}")
    return out


def _occurrences(docs: DataFrame, sought: Bloom) -> DataFrame:
    """digest, term and spans of the words of each document that the filter passes, but for those within base spans."""
    shared = docs.sparkSession.sparkContext.broadcast(sought)  # a bounded number of bits

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        passes = _Passes(shared.value)
        for frame in frame_slices(frames):
            rows = []
            for digest, text in zip(frame["digest"], frame["text"], strict=True):
                if own := {*passes(terms_of(text))}:
                    rows += [(digest, t, s) for t, s in outside(text, own, [s for spans in base_spans(text).values() for s in spans]).items()]
            yield pd.DataFrame(rows, columns=["digest", "term", "spans"])

    rows = docs.select(_digest().alias("digest"), text_or_empty().alias("text"))
    return rows.mapInPandas(run, "digest binary, term string, spans array<string>")


def revealing_terms(docs: DataFrame, found: DataFrame, support: int = SUPPORT, threshold: float = THRESHOLD, remove: float = REMOVE) -> DataFrame:
    """term and kind (removed, or general- and the kind of the entity) of the terms that disclose an entity."""
    texts = found.groupBy("digest").agg(F.count("*").alias("copies"))
    copied = texts.filter("copies > 1").select("digest")
    once = materialize(found.filter(F.size("entities") > 0).dropDuplicates(["digest"]).select("entities", "near"), "once")
    pairs = once.select(F.explode("near").alias("p")).groupBy("p.entity", "p.term").agg(F.count("*").alias("n_te"))
    likely = materialize(pairs.filter(F.col("n_te") >= support), "likely")
    often = _term_counts(docs, bloom_of(likely.select("term").distinct()), bloom_of(copied))
    entities = once.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("n_e"))
    n = F.lit(float(max(texts.count(), 1)))
    scored = likely.join(often, "term").join(entities, "entity")
    content = F.log2(n / F.col("n_e"))
    scored = scored.withColumn("disclosure", F.when(content > 0, F.log2(n * F.col("n_te") / (F.col("n_t") * F.col("n_e"))) / content).otherwise(0.0))
    # hashed entities have no kind in their names: it is told by their groups, which disclose as much or less
    kind = F.when(F.split("entity", ":")[0].isin(*KINDS), F.split("entity", ":")[0])
    flagged = scored.groupBy("term").agg(F.max("disclosure").alias("disclosure"), F.max(F.when(kind.isNotNull(), F.struct("disclosure", kind.alias("kind")))).alias("of")).filter(F.col("disclosure") >= threshold)
    return flagged.select("term", F.when(F.col("disclosure") >= remove, "removed").otherwise(F.concat(F.lit("general-"), F.coalesce("of.kind", F.lit("any")))).alias("kind"))


def _added(docs: DataFrame, found: DataFrame) -> DataFrame:
    """digest and added (a list of kind:start:end) of the texts with revealing terms."""
    terms = materialize(revealing_terms(docs, found), "terms")
    seen = _occurrences(docs, bloom_of(terms.select("term"))).join(terms, "term").dropDuplicates(["digest", "term"])
    each = seen.select("digest", F.transform("spans", lambda s: F.concat(F.col("kind"), F.lit(":"), s)).alias("spans"))
    return materialize(each.groupBy("digest").agg(F.flatten(F.collect_list("spans")).alias("added")), "added")


def personal_spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans of each document."""
    found = materialize(find_base(docs), "personal")
    # texts with revealing terms are few: Spark broadcasts them below its size limit, and else splits the skewed digests of ``found``
    both = found.drop("entities", "near").join(_added(docs, found), "digest", "left")
    place = lambda s: F.struct(F.startswith(s, F.lit("general")).alias("k"), F.split(s, ":")[1].cast("int").alias("a"), s.alias("s"))
    extra = F.transform(F.sort_array(F.transform(F.coalesce("added", F.array().cast("array<string>")), place)), lambda x: x["s"])
    spans = F.array_join(F.array_compact(F.array(F.nullif("base", F.lit("")), F.nullif(F.array_join(extra, ","), F.lit("")))), ",")
    return both.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", spans.alias("spans"))


#: What stands for a span of each kind in a sanitised text.
LABELS = {"email": "<EMAIL>", "ip": "<IP>", "card": "<CARD>", "phone": "<PHONE>", "removed": "", "general-any": "<TERM>"} | {f"general-{k}": f"<{k.upper()}-TERM>" for k in KINDS}


def replaced(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with its spans replaced; of spans that overlap, the first one's label stands for all of them."""
    out, at = [], 0
    for a, b, kind in sorted(spans, key=lambda s: (s[0], -s[1])):
        if a >= at:
            out += [text[at:a], LABELS[kind]]
        at = max(at, b)
    return "".join([*out, text[at:]])


def sanitised(docs: DataFrame) -> DataFrame:
    """``docs`` with the personal data in ``text`` replaced, and n_chars (if there is such a column) counted anew."""
    found = materialize(find_base(docs), "personal")
    rows = docs.select(whole(docs).alias("row"), "text", _digest().alias("digest")).join(_added(docs, found), "digest", "left")

    def clean(texts: pd.Series, added: pd.Series) -> pd.Series:
        out = []
        for text, more in zip(texts, added, strict=True):
            if text is None:
                out.append(None)
                continue
            spans = [(a, b, k) for k, own in base_spans(text).items() for a, b in own]
            for s in more if more is not None else ():
                kind, a, b = s.split(":")
                spans.append((int(a), int(b), kind))
            out.append(replaced(text, spans) if spans else text)
        return pd.Series(out, dtype=object)

    rows = rows.select("row", F.pandas_udf(clean, StringType())("text", "added").alias("text"))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return rows.select(*(new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))


def disclosure(n: int, n_t: int, n_e: int, n_te: int) -> float:
    """The share of what is to know about an entity that a term gives away."""
    content = math.log2(n / n_e)
    return math.log2(n * n_te / (n_t * n_e)) / content if content > 0 else 0.0
