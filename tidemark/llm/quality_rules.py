"""Quality rules by distribution divergence, in DataFrame functions only.

Each document's character-class histogram and common-word histogram is compared with the reference of its language by
the Jensen-Shannon distance.  The references are the mean shares of all documents of the language in the corpus that pass
the base rules, so they come from one aggregation with a row for each of the (fixed, four) languages.

A text without a single common word is in none of these languages (its language is null).  Its classes are compared with
those of all languages together, letters of whatever script and case as one class, and its words with nothing.

Defined results: a null text is an empty text; an empty text has no words and fails the base rules; a text whose language
has no reference is judged by the base rules alone; of languages that are equally near the first in the list counts; equal rows are judged alike; very long
texts are read whole; an empty table gives an empty result;
other columns of the input are ignored by ``quality_rules`` and kept by ``kept_documents``, whatever their names.

The texts are read once: counts and histograms are written to the shared folder, and references and verdicts come from
that narrow table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import materialize, text_or_empty, whole

# Frequent function words by language.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "for", "with", "on", "as", "by"],
    "fr": ["le", "la", "les", "de", "des", "un", "une", "et", "en", "que", "qui", "pour"],
    "de": ["der", "die", "das", "und", "den", "von", "zu", "mit", "ist", "nicht", "ein", "sich"],
    "es": ["el", "la", "los", "de", "que", "y", "en", "un", "con", "por", "se", "del"],
}
#: Character classes in the order in which they are taken out of the text; what is left is "other".
CLASSES = {"lower": r"\p{Ll}+", "upper": r"\p{Lu}+", "digit": r"\p{Nd}+", "symbol": r"[#*$%&|<>]+", "punct": r"[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]+"}
SPACE = r"[\x20\x09-\x0D]+"
MIN_WORDS = 50
#: Words that a language's reference needs before it judges anything.
MIN_REFERENCE_WORDS = 1000
#: A distance may reach limit + slack / sqrt(words): short texts scatter more.
LIMITS = {"classes": (0.10, 1.2), "words": (0.05, 1.9)}

_ALL = sorted({w for words in COMMON_WORDS.values() for w in words})


def _cased(words: list[str]) -> list[str]:
    return [*words, *(w.capitalize() for w in words)]


def _removed(before: str, after: str) -> Column:
    return F.length(before) - F.length(after)


def _histograms(docs: DataFrame) -> DataFrame:
    """Adds _words, n_words, word_chars, n_symbols, _classes (counts by class), language and _common (counts of its common words, then the rest)."""
    trimmed = F.btrim(text_or_empty(), F.lit(" \t\n\x0b\x0c\r"))
    df = docs.withColumn("_trimmed", trimmed)
    df = df.withColumn("_words", F.when(F.col("_trimmed") == "", F.array().cast("array<string>")).otherwise(F.split("_trimmed", SPACE)))
    df = df.withColumn("_r", F.array_join("_words", ""))
    df = df.withColumn("word_chars", F.length("_r").cast("long")).withColumn("n_words", F.size("_words").cast("long"))
    left, names = "_r", []
    for name, pattern in CLASSES.items():
        df = df.withColumn(f"_r_{name}", F.regexp_replace(left, pattern, ""))
        df = df.withColumn(f"_n_{name}", _removed(left, f"_r_{name}"))
        names.append(f"_n_{name}")
        left = f"_r_{name}"
    df = df.withColumn("_classes", F.array(*names, F.length(left))).withColumn("n_symbols", F.col("_n_symbol").cast("long"))
    # the common words alone, each between two blanks: a word's count is what its removal shortens the string by
    df = df.withColumn("_found", F.filter("_words", lambda w: w.isin(_cased(_ALL))))
    df = df.withColumns({f"_h_{lang}": F.size(F.filter("_found", lambda w: w.isin(_cased(words)))) for lang, words in COMMON_WORDS.items()})  # noqa: B023
    df = df.withColumn("_best", F.greatest(*(F.col(f"_h_{lang}") for lang in COMMON_WORDS)))
    language, own = F.when(F.col("_best") == 0, F.lit(None).cast("string")), F.when(F.col("_best") == 0, F.lit(None).cast("array<string>"))
    for lang, words in COMMON_WORDS.items():  # the language whose words are most; the first of them at a tie
        first = F.col(f"_h_{lang}") == F.col("_best")
        language, own = language.when(first, lang), own.when(first, F.array(*map(F.lit, words)))
    df = df.withColumn("language", language).withColumn("_own", own)
    df = df.withColumn("_joined", F.lower(F.concat(F.lit(" "), F.array_join("_found", "  "), F.lit(" "))))
    sought = [F.concat(F.lit(" "), F.col("_own")[i], F.lit(" ")) for i in range(len(COMMON_WORDS["en"]))]
    counts = [((F.length("_joined") - F.length(F.replace("_joined", w, F.lit("")))) / F.length(w)).cast("int") for w in sought]
    df = df.withColumn("_common", F.when(F.col("_best") > 0, F.array(*counts, F.col("n_words").cast("int") - F.col("_best"))))
    return df.drop("_trimmed", "_r", "_found", "_own", "_joined", "_best", *(f"_r_{n}" for n in CLASSES), *names, *(f"_h_{lang}" for lang in COMMON_WORDS))


def _repeated(df: DataFrame) -> DataFrame:
    """n_repeat_words: the words that some 3-word window found twice or more covers.

    A window's hash and its place share a long, so that one sort of longs brings equal windows together; windows whose
    shortened hashes meet are then compared by the whole 64-bit hash.
    """
    n = F.size("_words")
    hashes = F.transform("_words", lambda x, i: F.xxhash64(x, F.get("_words", i + 1), F.get("_words", i + 2)))
    df = df.withColumn("_grams", F.when(n >= 3, F.slice(hashes, F.lit(1), n - 2)).otherwise(F.array().cast("array<bigint>")))
    df = df.withColumn("_some", F.size(F.array_distinct("_grams")) < F.size("_grams")).withColumn("_bits", F.ceil(F.log2(n + F.lit(2.0))).cast("int"))
    packed = F.expr("transform(_grams, (h, i) -> shiftleft(h, _bits) | i)")
    df = df.withColumn("_sorted", F.when(F.col("_some"), F.sort_array(packed)))
    met = F.expr("filter(_sorted, (x, j) -> shiftrightunsigned(x ^ coalesce(get(_sorted, j - 1), ~x), _bits) = 0 or shiftrightunsigned(x ^ coalesce(get(_sorted, j + 1), ~x), _bits) = 0)")
    df = df.withColumn("_met", met)
    pairs = F.expr("sort_array(transform(_met, x -> named_struct('h', get(_grams, int(x & (shiftleft(1L, _bits) - 1))), 'i', int(x & (shiftleft(1L, _bits) - 1)))))")
    df = df.withColumn("_pairs", pairs)
    same = lambda e, j: F.coalesce(F.get("_pairs", j)["h"] == e["h"], F.lit(False))
    again = F.filter("_pairs", lambda e, j: same(e, j - 1) | same(e, j + 1))
    starts = F.sort_array(F.transform(again, lambda e: e["i"]))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate(starts, zero, lambda a, s: F.struct((a["n"] + s + 3 - F.greatest(s, a["end"])).alias("n"), (s + 3).alias("end")), lambda a: a["n"])
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_grams", "_some", "_bits", "_sorted", "_met", "_pairs")


def measure(docs: DataFrame) -> DataFrame:
    """``docs`` (text, and columns whose names aren't made here) with the base counts and the two histograms, in one pass."""
    df = _repeated(_histograms(docs))
    df = df.withColumn("_lines", F.filter(F.split(text_or_empty(), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = df.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    return df.drop("_words", "_lines")


def base_failed(min_words: int = MIN_WORDS) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def language_references(measured: DataFrame, min_words: int = MIN_WORDS) -> dict[str | None, dict[str, list[float]]]:
    """Mean shares of each class and common word by language, over all documents that pass the base rules.

    A document's shares are whole millionths, so that their sums don't depend on the order, and a long document counts
    as much as a short one.  Those of all languages together, with merged classes, are under None.  One row for each language of ``COMMON_WORDS`` at most reaches the driver.
    """
    df = measured.filter(~base_failed(min_words) & F.col("language").isNotNull())
    whole = {"_classes": "word_chars", "_common": "n_words"}
    sums = lambda c, n: [F.sum(F.expr(f"{c}[{i}] * 1000000L div {whole[c]}")).alias(f"{c}{i}") for i in range(n)]
    sizes = {"_classes": len(CLASSES) + 1, "_common": len(COMMON_WORDS["en"]) + 1}
    refs, pooled, pooled_words = {}, [0] * 4, 0
    for r in df.groupBy("language").agg(F.sum("n_words").alias("n"), *sums("_classes", sizes["_classes"]), *sums("_common", sizes["_common"])).collect():
        if r["n"] >= MIN_REFERENCE_WORDS:
            counts = {c: [r[f"{c}{i}"] for i in range(n)] for c, n in sizes.items()}
            refs[r["language"]] = {c: [x / sum(v) for x in v] for c, v in counts.items()}
        pooled = [a + b for a, b in zip(pooled, merged_classes([r[f"_classes{i}"] for i in range(sizes["_classes"])]), strict=True)]
        pooled_words += r["n"]
    if pooled_words >= MIN_REFERENCE_WORDS:
        refs[None] = {"_classes": [x / sum(pooled) for x in pooled]}
    return refs


def merged_classes(counts: list) -> list:
    """Counts by class with letters (lower, upper and other) as one class."""
    lower, upper, digit, symbol, punct, other = counts
    return [lower + upper + other, digit, symbol, punct]


def js_distance(p: Column, q: Column) -> Column:
    """Square root of the Jensen-Shannon divergence (base 2) of two arrays of shares."""
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    terms = F.zip_with(p, q, lambda x, y: part(x, (x + y) / 2) + part(y, (x + y) / 2))
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2, F.lit(0.0)))


def judge(measured: DataFrame, references: dict, min_words: int = MIN_WORDS) -> DataFrame:
    """``measured`` with base_failed, js_classes, js_words and kept."""
    df = measured.withColumn("base_failed", base_failed(min_words))
    judged = F.col("n_words") >= min_words  # below the length that a reference needs there is nothing to compare
    for kind, counts, total in (("classes", "_classes", "word_chars"), ("words", "_common", "n_words")):
        shares = F.transform(counts, lambda x: x / F.col(total))  # noqa: B023
        distance = F.lit(None).cast("double")
        for lang, ref in references.items():
            if lang is None:
                continue
            distance = F.when(judged & (F.col("language") == lang), js_distance(shares, F.array(*map(F.lit, ref[counts])))).otherwise(distance)
        df = df.withColumn(f"js_{kind}", distance)
    if None in references:
        shares = F.array(*merged_classes([F.col("_classes")[i] / F.col("word_chars") for i in range(len(CLASSES) + 1)]))
        far = js_distance(shares, F.array(*map(F.lit, references[None]["_classes"])))
        df = df.withColumn("js_classes", F.when(judged & F.col("language").isNull(), far).otherwise(F.col("js_classes")))
    within = [F.coalesce(F.col(f"js_{k}") <= limit + slack / F.sqrt(F.col("n_words")), F.lit(True)) for k, (limit, slack) in LIMITS.items()]
    return df.withColumn("kept", ~F.col("base_failed") & within[0] & within[1])


def kept_documents(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with the columns and values of ``docs``."""
    measured = materialize(measure(docs.select(whole(docs).alias("row"), "text")).drop("text"), "quality")
    return judge(measured, language_references(measured)).filter("kept").select("row.*")


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row for each document: the base counts and the verdict."""
    measured = materialize(measure(docs.select("doc_id", "text")).drop("text"), "quality")
    return judge(measured, language_references(measured)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "language")


def oracle() -> str:
    """The same rules in DuckDB's SQL over a table ``documents``."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    n_common, n_classes = len(COMMON_WORDS["en"]), len(CLASSES)
    removed, left = [], "r"
    for name, pattern in CLASSES.items():
        removed.append(f"regexp_replace({left}, {quoted(pattern)}, '', 'g') AS r_{name}")
        left = f"r_{name}"
    before = ["r", *(f"r_{n}" for n in CLASSES)]
    classes = ", ".join([f"length({a}) - length({b})" for a, b in zip(before, before[1:], strict=False)] + [f"length({before[-1]})"])
    counts = {lang: "[" + ", ".join(f"len(list_filter(ws, lambda x: x IN ({quoted(w)}, {quoted(w.capitalize())})))" for w in words) + "]" for lang, words in COMMON_WORDS.items()}
    langs = list(COMMON_WORDS)
    pick = lambda what, none: "CASE WHEN best = 0 THEN " + none + " " + " ".join(f"WHEN h_{x} = best THEN {what(x)}" for x in langs) + " END"
    steps = "".join(f", c{i + 1} AS (SELECT *, {step} FROM c{i})" for i, step in enumerate(removed))
    millionths = lambda c, i, total: f"sum({c}[{i + 1}]::BIGINT * 1000000 // {total})"
    share = lambda c, n, total: "[" + ", ".join(f"{millionths(c, i, total)}::DOUBLE / ({' + '.join(millionths(c, k, total) for k in range(n))})" for i in range(n)) + "]"
    part = lambda x, m: f"CASE WHEN {x} > 0 THEN {x} * log2({x} / ({m})) ELSE 0 END"

    def js(counted: str, total: str, ref: str, n: int) -> str:
        terms = []
        for i in range(1, n + 1):
            p, q = f"({counted}[{i}] / {total})", f"{ref}[{i}]"
            m = f"({p} + {q}) / 2"
            terms.append(f"({part(p, m)} + {part(q, m)})")
        return f"sqrt(greatest(({' + '.join(terms)}) / 2, 0))"

    sums = [millionths("classes", i, "word_chars") for i in range(n_classes + 1)]
    pooled = [f"({sums[0]} + {sums[1]} + {sums[5]})", *sums[2:5]]
    pool = "[" + ", ".join(f"{x}::DOUBLE / ({' + '.join(pooled)})" for x in pooled) + "]"
    merged = "[m.classes[1] / m.word_chars + m.classes[2] / m.word_chars + m.classes[6] / m.word_chars, m.classes[3] / m.word_chars, m.classes[4] / m.word_chars, m.classes[5] / m.word_chars]"
    limit = {k: f"{a} + {b} / sqrt(n_words)" for k, (a, b) in LIMITS.items()}
    return rf"""
WITH w AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
grams AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, ws[i], ws[i + 1], ws[i + 2]) AS n FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
again AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM grams WHERE n > 1) GROUP BY rid),
dups AS (SELECT rid, len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS n FROM w),
c0 AS (SELECT *, array_to_string(ws, '') AS r, len(ws) AS n_words, {', '.join(f'{c} AS c_{x}' for x, c in counts.items())} FROM w){steps},
h AS (SELECT *, [{classes}] AS classes, length(r) AS word_chars, length(r_digit) - length(r_symbol) AS n_symbols, {', '.join(f'list_sum(c_{x}) AS h_{x}' for x in langs)} FROM c{len(removed)}),
b AS (SELECT *, greatest({', '.join(f'h_{x}' for x in langs)}) AS best FROM h),
m AS (SELECT rid, doc_id, n_words, word_chars, n_symbols, classes, {pick(lambda x: quoted(x), 'NULL')} AS language, {pick(lambda x: f'list_append(c_{x}, n_words - best)', 'NULL')} AS common FROM b),
s AS (SELECT m.*, coalesce(a.n, 0) AS n_repeat_words FROM m LEFT JOIN again a USING (rid)),
refs AS (SELECT language, {share('classes', n_classes + 1, 'word_chars')} AS rc, {share('common', n_common + 1, 'n_words')} AS rw FROM s WHERE n_words >= {MIN_WORDS} AND 100 * n_repeat_words <= 50 * n_words AND language IS NOT NULL GROUP BY language HAVING sum(n_words) >= {MIN_REFERENCE_WORDS}),
pool AS (SELECT {pool} AS rc FROM s WHERE n_words >= {MIN_WORDS} AND 100 * n_repeat_words <= 50 * n_words AND language IS NOT NULL HAVING sum(n_words) >= {MIN_REFERENCE_WORDS}),
m2 AS (SELECT m.*, {merged} AS merged, (SELECT any_value(rc) FROM pool) AS pc FROM s m),
j AS (SELECT m.*, d.n AS n_dup_lines, CASE WHEN m.n_words >= {MIN_WORDS} AND m.language IS NULL THEN {js('m.merged', '1', 'm.pc', 4)} WHEN m.n_words >= {MIN_WORDS} THEN {js('m.classes', 'm.word_chars', 'f.rc', n_classes + 1)} END AS jc,
  CASE WHEN m.n_words >= {MIN_WORDS} THEN {js('m.common', 'm.n_words', 'f.rw', n_common + 1)} END AS jw
  FROM m2 m JOIN dups d USING (rid) LEFT JOIN refs f ON f.language = m.language),
k AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM j)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND coalesce(jc <= {limit['classes']}, true) AND coalesce(jw <= {limit['words']}, true) AS kept, language FROM k
"""
