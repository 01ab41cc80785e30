"""Registered queries over vectors, texts, bands and plain tables, each with the SQL that checks it where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import bands as N
from ..operators import baseline as B
from ..operators import counts as C
from ..operators import links as K
from ..operators import templates as M
from ..sources import driver_tables as S
from ..sources import shared
from ..streaming import live, minutes
from .log_queries import BASE, CLASS, MINUTES, ORACLES, QUERIES, _changed, _days, _lines, _parts, _stated, query

__all__ = ["ORACLES", "QUERIES"]

# ---- links

DOT = "list_dot_product({a}::DOUBLE[], {b}::DOUBLE[])"
SIM = DOT.format(a="t.embedding", b="s.embedding")
LINES_OF_DOCS = "SELECT id, class, embedding, 'DOC-' || (label % 7) AS doc FROM vectors WHERE manual"


@query(f"""WITH {S.VECTORS_SQL}, p AS (SELECT t.id, t.class, s.id AS doc, {SIM} AS sim, row_number() OVER (PARTITION BY t.id ORDER BY round({SIM}, 9) DESC, s.id) AS rn
FROM vectors t JOIN vectors s ON s.manual AND NOT t.manual AND s.service = t.service AND s.class = t.class)
SELECT id, doc, round(sim, 6) AS sim FROM p WHERE rn = 1 AND sim >= CASE class WHEN 'ERROR' THEN 0.25 WHEN 'WARN' THEN 0.3 ELSE 0.35 END""")
def l3_j6_inherited(spark, sf):
    """The nearest manual template of the service and class, at thresholds that suit these vectors."""
    rows = S.vectors(spark, sf)
    pairs = K.similar(rows.filter("NOT manual"), rows.filter("manual"), ["service", "class"], 0.25, 1)
    # ranked by nine places, but what is shown is not rounded twice
    found = K.nearest(pairs.withColumn("whole", F.col("sim")).withColumn("sim", F.round("sim", 9))).filter(F.col("whole") >= K.by_class(F.col("class"), {"ERROR": 0.25, "WARN": 0.3, "INFO": 0.35}))
    return found.select("id", F.col("other").alias("doc"), F.round("whole", 6).alias("sim"))


def _doc_lines(spark: SparkSession, sf: str) -> DataFrame:
    return S.vectors(spark, sf).filter("manual").select("id", "class", "embedding", F.concat(F.lit("DOC-"), F.col("label") % 7).alias("doc"))


@query(f"""WITH {S.VECTORS_SQL}, d AS ({LINES_OF_DOCS}), per AS (SELECT t.id, t.class, s.doc, max({SIM}) AS sim FROM vectors t JOIN d s ON s.class = t.class WHERE NOT t.manual GROUP BY ALL),
r AS (SELECT *, row_number() OVER w AS rn, lead(sim) OVER w AS second FROM per WINDOW w AS (PARTITION BY id ORDER BY sim DESC, doc))
SELECT id, doc, round(sim, 6) AS sim FROM r WHERE rn = 1 AND sim >= 0.25 AND sim - coalesce(second, -1) >= 0.05""")
def l4_w2_corpus(spark, sf):
    out = K.corpus(S.vectors(spark, sf), _doc_lines(spark, sf), {"ERROR": 0.25, "WARN": 0.25, "INFO": 0.25})
    return out.withColumn("sim", F.round("sim", 6))


@query(f"""WITH {S.VECTORS_SQL} SELECT t.service, t.id AS a, s.id AS b, round({SIM}, 6) AS sim FROM vectors t JOIN vectors s ON s.service = t.service AND t.id < s.id WHERE {SIM} >= 0.4""")
def j9_l6_edges(spark, sf):
    return K.edges(S.vectors(spark, sf), 0.4).withColumn("sim", F.round("sim", 6))


@query(f"""WITH RECURSIVE {S.VECTORS_SQL}, e AS (SELECT t.id AS a, s.id AS b FROM vectors t JOIN vectors s ON s.service = t.service AND t.id <> s.id WHERE {SIM} >= 0.4),
reach AS (SELECT id, id AS other FROM vectors UNION SELECT r.id, e.b FROM reach r JOIN e ON e.a = r.other) SELECT id, min(other) AS cluster FROM reach GROUP BY id""")
def g1_clusters(spark, sf):
    rows = S.vectors(spark, sf)
    return K.clusters(rows.select("id"), K.edges(rows, 0.4))


@query(f"""WITH {S.VECTORS_SQL}, d AS ({LINES_OF_DOCS}), per AS (SELECT t.id, t.label, s.doc, max({SIM}) AS sim FROM vectors t JOIN d s ON s.class = t.class WHERE NOT t.manual GROUP BY ALL),
r AS (SELECT *, row_number() OVER w AS rn, lead(sim) OVER w AS second FROM per WINDOW w AS (PARTITION BY id ORDER BY sim DESC, doc)), b AS (SELECT *, 'DOC-' || (label % 7) AS truth FROM r WHERE rn = 1),
g AS (SELECT b.*, t.threshold, m.margin FROM b, (VALUES (0.2::DOUBLE), (0.3)) t(threshold), (VALUES (0.0::DOUBLE), (0.05)) m(margin))
SELECT threshold, margin, count(*) FILTER (c AND doc = truth) AS "right", count(*) FILTER (c AND doc <> truth) AS wrong, count(*) FILTER (NOT c) AS "none" FROM (SELECT *, sim >= threshold AND sim - coalesce(second, -1) >= margin AS c FROM g) GROUP BY ALL""")
def l7_link_evaluation(spark, sf):
    rows = S.vectors(spark, sf)
    pairs = K.best_by_doc(rows.filter("NOT manual"), _doc_lines(spark, sf), ["class"])
    return K.evaluation(pairs, rows.select("id", F.concat(F.lit("DOC-"), F.col("label") % 7).alias("truth")), [0.2, 0.3], [0.0, 0.05])


@query("""WITH d AS (SELECT o_orderkey AS id, o_custkey AS doc, CASE o_orderkey % 2 WHEN 0 THEN 'corpus' ELSE 'inherited' END AS source, 0.9::DOUBLE AS sim FROM orders WHERE o_orderkey % 3 <> 0),
c AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN o_custkey + 1 ELSE o_custkey END AS doc, CASE WHEN o_orderkey % 11 = 0 THEN 'manual' WHEN o_orderkey % 2 = 0 THEN 'corpus' ELSE 'inherited' END AS source, 0.9::DOUBLE AS sim FROM orders WHERE o_orderkey % 5 <> 0)
SELECT coalesce(d.id, c.id) AS id, CASE WHEN c.source = 'manual' THEN 'keep' WHEN d.id IS NULL THEN 'delete' WHEN c.id IS NULL THEN 'insert' WHEN c.doc = d.doc AND c.source = d.source THEN 'keep' ELSE 'update' END AS action,
CASE WHEN c.source = 'manual' THEN c.doc ELSE coalesce(d.doc, c.doc) END AS doc FROM d FULL JOIN c ON d.id = c.id""")
def j19_l5_reconcile(spark, sf):
    o = S.table(spark, sf, "orders")
    k = F.col("o_orderkey")
    auto = F.when(k % 2 == 0, "corpus").otherwise("inherited")
    desired = o.filter(k % 3 != 0).select(k.alias("id"), F.col("o_custkey").alias("doc"), auto.alias("source"), F.lit(0.9).alias("sim"))
    current = o.filter(k % 5 != 0).select(k.alias("id"), F.when(k % 7 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")).alias("doc"), F.when(k % 11 == 0, "manual").otherwise(auto).alias("source"), F.lit(0.9).alias("sim"))
    return K.reconciled(desired, current)


@query(f"""WITH {S.VECTORS_SQL} SELECT id, round(sqrt({DOT.format(a='embedding', b='embedding')}), 6) AS length FROM vectors""")
def m8_lengths(spark, sf):
    v = F.col("embedding")
    return S.vectors(spark, sf).select("id", F.round(F.sqrt(K.dot(v, v)), 6).alias("length"))


# ---- bands

HISTORY = f"""{BASE}, hist AS (SELECT k.service, k.key, h.day, h.hour, h.n_minutes AS n, coalesce(m.sum, 0)::BIGINT AS s, coalesce(m.sumsq, 0)::BIGINT AS q FROM (SELECT DISTINCT service, key FROM moments WHERE key NOT IN ('*warn', '*info')) k JOIN hours h ON h.service = k.service LEFT JOIN moments m ON m.service = k.service AND m.key = k.key AND m.day = h.day AND m.hour = h.hour WHERE h.n_minutes > 0),
tests AS (SELECT service, key, day, hour FROM hist),
picks AS (SELECT *, row_number() OVER (PARTITION BY service, day ORDER BY past DESC) AS rn FROM (SELECT t.service, t.day, d.day AS past, d.daytype FROM (SELECT DISTINCT service, day FROM tests) t JOIN days d ON d.service = t.service AND d.day < t.day AND (d.daytype = 'weekend') = (isodow(t.day) >= 6))),
trained AS (SELECT t.*, h.day AS past, h.n, h.s, h.q FROM tests t JOIN picks p ON p.service = t.service AND p.day = t.day AND p.rn <= CASE p.daytype WHEN 'weekday' THEN 5 ELSE 4 END JOIN hist h ON h.service = t.service AND h.key = t.key AND h.day = p.past AND h.hour = t.hour),
trained28 AS (SELECT t.*, h.day AS past, h.n, h.s, h.q FROM tests t JOIN picks p ON p.service = t.service AND p.day = t.day AND t.day - p.past <= 28 JOIN hist h ON h.service = t.service AND h.key = t.key AND h.day = p.past AND h.hour = t.hour)"""
SIGMA_SQL = """sigma AS (SELECT service, key, day, hour, sum(s)::DOUBLE / sum(n) AS mean, greatest(sum(q)::DOUBLE / sum(n) - (sum(s)::DOUBLE / sum(n)) ** 2, 0) AS var FROM trained GROUP BY ALL HAVING sum(s) > 0)"""


def _trained(spark: SparkSession, sf: str, ewma: bool = False) -> tuple[DataFrame, DataFrame]:
    moments, hours, days, _ = _parts(spark, sf)
    keys = moments.filter("key NOT IN ('*warn', '*info')").select("service", "key").distinct()
    grid = keys.join(hours.filter("n_minutes > 0"), "service").join(moments, ["service", "key", "day", "hour"], "left")
    history = shared.stored(grid.select("service", "key", "day", "hour", F.col("n_minutes").alias("n"), F.coalesce("sum", F.lit(0)).alias("s"), F.coalesce("sumsq", F.lit(0)).alias("q")), "history")
    # every day is a test day; what it learns from are the committed days before it
    return N.training(history, history.select("service", "key", "day", "hour"), days, ewma), history


def _rounded(band: DataFrame) -> DataFrame:
    return band.select("service", "key", "day", "hour", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query(f"WITH {HISTORY}, {SIGMA_SQL} SELECT service, key, day, hour, round(mean - 3 * sqrt(var), 6) AS low, round(mean + 3 * sqrt(var), 6) AS high FROM sigma")
def b1_sigma(spark, sf):
    return _rounded(N.sigma_band(_trained(spark, sf)[0], 3.0))


@query(f"""WITH {HISTORY}, r AS (SELECT *, s / n AS m, greatest(q / n - (s / n) ** 2, 0) AS v FROM trained), c AS (SELECT service, key, day, hour, median(m) AS c, median(v) AS v, count(*) AS rows, sum(s) AS total FROM r GROUP BY ALL),
d AS (SELECT r.service, r.key, r.day, r.hour, median(abs(r.m - c.c)) AS mad FROM r JOIN c USING (service, key, day, hour) GROUP BY ALL)
SELECT service, key, day, hour, round(c - 3 * sqrt(v + (1.4826 * mad) ** 2), 6) AS low, round(c + 3 * sqrt(v + (1.4826 * mad) ** 2), 6) AS high FROM c JOIN d USING (service, key, day, hour) WHERE rows >= 3 AND total > 0""")
def b1_median(spark, sf):
    return _rounded(N.median_band(_trained(spark, sf)[0], 3.0))


@query(f"""WITH {HISTORY}, w AS (SELECT *, 0.5 ** ((max(past) OVER (PARTITION BY service, key, day, hour) - past) / 2.0) AS w FROM trained28),
p AS (SELECT service, key, day, hour, sum(w * s) / sum(w * n) AS m, sum(w * q) / sum(w * n) AS q2, count(*) AS rows, sum(s) AS total FROM w GROUP BY ALL)
SELECT service, key, day, hour, round(m - 3 * sqrt(greatest(q2 - m * m, 0)), 6) AS low, round(m + 3 * sqrt(greatest(q2 - m * m, 0)), 6) AS high FROM p WHERE rows >= 2 AND total > 0""")
def b1_w10_ewma(spark, sf):
    return _rounded(N.ewma_band(_trained(spark, sf, ewma=True)[0], 3.0))


@query()
def b1_m2_nb(spark, sf):
    return _rounded(N.nb_band(_trained(spark, sf)[0], 3.0))


@query(f"""WITH {HISTORY}, {SIGMA_SQL}, m AS (SELECT t.service, t.key, t.day, t.hour, t.s AS n, s.mean * 60 - 3 * sqrt(s.var) * 8 AS low, s.mean * 60 + 3 * sqrt(s.var) * 8 AS high FROM hist t JOIN sigma s USING (service, key, day, hour))
SELECT service, key, count(*) AS n, round(avg((n BETWEEN low AND high)::INT), 9) AS coverage, round(avg(high - low + 400 * greatest(low - n, 0) + 400 * greatest(n - high, 0)), 6) AS score, round(avg(high - low), 6) AS width FROM m GROUP BY ALL""")
def a17_m6_band_scores(spark, sf):
    """Hourly sums under the hourly form of the sigma band."""
    trained, tests = _trained(spark, sf)
    band = N.sigma_band(trained, 3.0)
    hourly = band.withColumn("low", F.col("mean") * 60 - 3 * F.sqrt("var") * 8).withColumn("high", F.col("mean") * 60 + 3 * F.sqrt("var") * 8)
    counts = tests.select("service", "key", "day", "hour", F.col("s").alias("n"))
    out = N.band_scores(counts, hourly, ["service", "key"])
    return out.select("service", "key", "n", F.round("coverage", 9).alias("coverage"), F.round("score", 6).alias("score"), F.round("width", 6).alias("width"))


@query(f"""WITH {HISTORY}, {SIGMA_SQL}, last3 AS (SELECT service, day FROM (SELECT *, row_number() OVER (PARTITION BY service ORDER BY day DESC) AS rn FROM days) WHERE rn <= 3),
m AS (SELECT t.service, t.s AS n, s.mean * 60 AS mean, s.var * 64 AS var FROM hist t JOIN sigma s USING (service, key, day, hour) JOIN last3 USING (service, day) WHERE key = '*total'), g AS (SELECT m.*, k::DOUBLE AS k FROM m, range(2, 9) r(k)),
p AS (SELECT service, k, avg((abs(n - mean) <= k * sqrt(var))::INT) AS coverage FROM g GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY service ORDER BY coverage >= 0.995 DESC, CASE WHEN coverage >= 0.995 THEN k ELSE -k END) AS rn FROM p)
SELECT service, k, round(coverage, 9) AS coverage, coverage >= 0.995 AS reached FROM r WHERE rn = 1""")
def b3_b16_tuned(spark, sf):
    """The least of the sigmas from 2 to 8 whose band covers 99.5 % of the hours of the last three committed days."""
    trained, tests = _trained(spark, sf)
    last = Window.partitionBy("service").orderBy(F.desc("day"))
    days = _days(spark, sf)[1].withColumn("rn", F.row_number().over(last)).filter("rn <= 3").select("service", "day")
    centre = N.sigma_band(trained.filter("key = '*total'"), 3.0).withColumn("mean", F.col("mean") * 60).withColumn("var", F.col("var") * 64)
    counts = tests.filter("key = '*total'").join(days, ["service", "day"], "left_semi").select("service", "key", "day", "hour", F.col("s").alias("n"))
    return N.tuned(counts, centre, [float(k) for k in range(2, 9)], 0.995).withColumn("coverage", F.round("coverage", 9))


# ---- text


@query("SELECT doc_id, len(string_split(text, chr(10))) AS n_lines, len(regexp_replace(text, '[0-9]+', '<*>', 'g')) AS masked FROM documents WHERE strpos(lower(text), 'license') > 0")
def f6_f10_p4_masks(spark, sf):
    d = S.table(spark, sf, "documents").filter(F.instr(F.lower("text"), "license") > 0)
    return d.select("doc_id", F.size(F.split("text", "\n")).cast("long").alias("n_lines"), F.length(F.regexp_replace("text", "[0-9]+", "<*>")).cast("long").alias("masked"))


@query()
def f1_f12_normalised(spark, sf):
    """Normalised lines of whole documents that say something, in order; each distinct line is normalised once."""
    d = S.table(spark, sf, "documents")
    placed = d.select("doc_id", F.posexplode(T.lines_of(F.col("text"))).alias("place", "line"))
    wordings = placed.select("line").distinct().withColumn("wording", T.normalised(F.col("line"), None, None)).filter(T.wording(F.col("wording")))
    lines = placed.join(wordings, "line").groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "wording"))), lambda x: x["wording"]).alias("lines"))
    return d.select("doc_id", T.find_level(F.col("text")).alias("level")).join(lines, "doc_id", "left").select("doc_id", F.coalesce("lines", F.array().cast("array<string>")).alias("lines"), "level")


@query()
def f3_f5_pages(spark, sf):
    p = S.table(spark, sf, "pages")
    return p.select("page_id", T.collapsed(T.tokens_of(T.reduced_xml(T.unescaped(F.col("html")))), None).alias("words"))


@query()
def l1_templates(spark, sf):
    """Templates of the whole turns of conversations, by role."""
    # the table may be one row group, so turns are dealt out before the work on their texts
    c = S.table(spark, sf, "conversations").repartition("conv_id", "turn")
    c = c.select(F.col("role").alias("service"), T.normalised(F.col("text"), None, None).alias("text"), (F.col("conv_id") * 1000 + F.col("turn")).alias("first_seen"))
    return M.mined(c.filter("text <> ''"))


@query("""WITH i AS (SELECT role, CASE turn % 4 WHEN 0 THEN 'DOC-' || lpad(conv_id::VARCHAR, greatest(3, len(conv_id::VARCHAR))::INT, '0') WHEN 1 THEN 'DOC-' || (conv_id + 5000000000)::VARCHAR WHEN 2 THEN 'doc-' || conv_id::VARCHAR ELSE 'DOC-' || conv_id::VARCHAR || 'x' END AS id FROM conversations),
n AS (SELECT role, coalesce(max(CASE WHEN regexp_full_match(id, 'DOC-[0-9]{1,9}') THEN substr(id, 5)::BIGINT END), 0) + 1 AS n FROM i GROUP BY role) SELECT role, 'DOC-' || lpad(n::VARCHAR, greatest(3, len(n::VARCHAR))::INT, '0') AS next_id FROM n""")
def p6_next_id(spark, sf):
    """The next id after those of the form DOC-001; others don't count."""
    c, t = S.table(spark, sf, "conversations"), F.col("turn") % 4
    n = F.col("conv_id").cast("string")
    made = F.when(t == 0, F.format_string("DOC-%03d", "conv_id")).when(t == 1, F.concat(F.lit("DOC-"), (F.col("conv_id") + 5000000000).cast("string"))).when(t == 2, F.concat(F.lit("doc-"), n)).otherwise(F.concat(F.lit("DOC-"), n, F.lit("x")))
    return c.select("role", made.alias("id")).groupBy("role").agg(T.next_doc_id(F.col("id")).alias("next_id"))


# ---- plain predicates and joins


@query(f"SELECT level, upper({CLASS}) AS class, count(*) AS n FROM (SELECT CASE user_id % 6 WHEN 0 THEN 'FATAL' WHEN 1 THEN 'WARNING' WHEN 2 THEN 'DEBUG' WHEN 3 THEN 'CRITICAL' WHEN 4 THEN NULL ELSE 'WARN' END AS level FROM events) GROUP BY ALL")
def p1_level_class(spark, sf):
    u = F.col("user_id") % 6
    level = F.when(u == 0, "FATAL").when(u == 1, "WARNING").when(u == 2, "DEBUG").when(u == 3, "CRITICAL").when(u == 5, "WARN")
    return S.table(spark, sf, "events").select(level.alias("level")).groupBy("level", C.level_class(F.col("level")).alias("class")).agg(F.count("*").alias("n"))


@query("SELECT count(*) FILTER (a IS NOT DISTINCT FROM b) AS same, count(*) FILTER ((a > 1) IS TRUE) AS sure, count(*) FILTER (a IS DISTINCT FROM b) AS other FROM (SELECT nullif(user_id % 3, 0) AS a, nullif(event_id % 3, 0) AS b FROM events)")
def p7_p8_null_safe(spark, sf):
    e = S.table(spark, sf, "events").select(F.nullif(F.col("user_id") % 3, F.lit(0)).alias("a"), F.nullif(F.col("event_id") % 3, F.lit(0)).alias("b"))
    same = F.col("a").eqNullSafe(F.col("b"))
    return e.agg(F.count_if(same).alias("same"), F.count_if(F.coalesce(F.col("a") > 1, F.lit(False))).alias("sure"), F.count_if(~same).alias("other"))


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE (l_returnflag, l_linestatus) IN (('A', 'F'), ('R', 'F')) AND l_shipdate < TIMESTAMP '1999-01-01' AND l_suppkey NOT IN (1, 2, 3)")
def p9_p10_row_lists(spark, sf):
    wanted = F.broadcast(spark.createDataFrame([("A", "F"), ("R", "F")], "l_returnflag string, l_linestatus string"))  # two rows
    li = S.table(spark, sf, "lineitem").filter((F.col("l_shipdate") < F.lit("1999-01-01").cast("timestamp_ntz")) & ~F.col("l_suppkey").isin(1, 2, 3))
    return li.join(wanted, ["l_returnflag", "l_linestatus"], "left_semi").select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT c.c_custkey, n.n_name, count(o.o_orderkey) AS orders, coalesce(round(sum(o.o_totalprice), 2), 0) AS total FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_orderstatus <> 'F' GROUP BY ALL")
def j1_j2_j4_star(spark, sf):
    c, n, o = (S.table(spark, sf, t) for t in ("customer", "nation", "orders"))
    per = o.filter("o_orderstatus <> 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    rows = c.join(F.broadcast(n), c["c_nationkey"] == n["n_nationkey"]).join(per, "c_custkey", "left")  # nations: 25 rows
    return rows.select("c_custkey", "n_name", F.coalesce("orders", F.lit(0)).alias("orders"), F.coalesce("total", F.lit(0.0)).alias("total"))


@query("SELECT c_custkey, c_mktsegment FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000) AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = '1-URGENT')")
def j10_j11_semi_anti(spark, sf):
    c, o = S.table(spark, sf, "customer"), S.table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    rows = c.join(o.filter("o_totalprice > 300000"), "c_custkey", "left_semi")
    return rows.join(o.filter("o_orderpriority = '1-URGENT'"), "c_custkey", "left_anti").select("c_custkey", "c_mktsegment")


@query("SELECT s_nationkey AS k FROM supplier UNION SELECT c_nationkey FROM customer WHERE c_acctbal < 0 EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 2")
def u1_union(spark, sf):
    s, c, n = (S.table(spark, sf, t) for t in ("supplier", "customer", "nation"))
    both = s.select(F.col("s_nationkey").alias("k")).union(c.filter("c_acctbal < 0").select("c_nationkey")).distinct()
    return both.join(F.broadcast(n.filter("n_regionkey = 2").select(F.col("n_nationkey").alias("k"))), "k", "left_anti")


@query(f"""WITH {MINUTES}, a AS (SELECT service, key, day, sum(n)::BIGINT AS n FROM minutes WHERE key = '*total' GROUP BY ALL), b AS (SELECT service, '*total' AS key, lts::DATE AS day, count(*) AS n FROM lines WHERE event_id % 97 <> 0 GROUP BY ALL)
SELECT coalesce(a.service, b.service) AS service, coalesce(a.day, b.day) AS day, a.n AS had, b.n AS got FROM a FULL JOIN b USING (service, key, day) WHERE a.n IS DISTINCT FROM b.n""")
def j18_mismatches(spark, sf):
    """Daily totals that differ between two snapshots."""
    lines = _lines(spark, sf)
    a = C.minute_counts(lines).filter("key = '*total'").groupBy("service", "day").agg(F.sum("n").alias("had"))
    b = lines.filter("event_id % 97 <> 0").groupBy("service", S.day_of().alias("day")).agg(F.count("*").alias("got"))
    return a.join(b, ["service", "day"], "full").filter(~F.col("had").eqNullSafe(F.col("got")))


@query("SELECT l_returnflag, sum(l_quantity) AS quantity, sum(l_extendedprice * (1 - l_discount)) AS revenue, count(*) AS n FROM (SELECT l_returnflag, l_quantity, round(l_extendedprice, 2)::DECIMAL(15,2) AS l_extendedprice, round(l_discount, 2)::DECIMAL(4,2) AS l_discount FROM lineitem) GROUP BY ALL".replace("sum(l_extendedprice * (1 - l_discount)) AS revenue", "round(sum(l_extendedprice * (1 - l_discount))::DOUBLE, 2) AS revenue").replace("sum(l_quantity)", "round(sum(l_quantity), 2)"))
def a11_grouped_sums(spark, sf):
    li = S.table(spark, sf, "lineitem").select("l_returnflag", "l_quantity", F.round("l_extendedprice", 2).cast("decimal(15,2)").alias("p"), F.round("l_discount", 2).cast("decimal(4,2)").alias("d"))
    return li.groupBy("l_returnflag").agg(F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.sum(F.col("p") * (1 - F.col("d"))).cast("double"), 2).alias("revenue"), F.count("*").alias("n"))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2")
def t3_top_each(spark, sf):
    order = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return S.table(spark, sf, "orders").withColumn("rn", F.row_number().over(order)).filter("rn <= 2").select("o_orderkey", "o_custkey", "o_totalprice")


# ---- streams


@query(f"WITH {S.LINES_SQL} SELECT service, template, date_trunc('hour', ts) AS start, count(*) AS n FROM lines GROUP BY ALL")
def x3_x5_stream_totals(spark, sf):
    """Counts by window: those that the stream closed, and from the table those of windows still open at the end."""
    folder = shared.folder(spark, "stream")
    spark.createDataFrame([], "service string, template string, start timestamp, n bigint").write.parquet(f"{folder}/out/batch=-1")
    stream = spark.readStream.schema(S.table(spark, sf, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    lines = stream.select("event_id", "ts", F.concat(F.lit("svc"), F.col("user_id") % 3).alias("service"), F.concat(F.lit("svc"), F.col("user_id") % 3, F.lit(":"), F.col("event_type")).alias("template"))
    live.replay(live.windowed_counts(lines, window="1 hour"), f"{folder}/out", f"{folder}/checkpoint")
    done = spark.read.schema("service string, template string, start timestamp, n bigint").parquet(f"{folder}/out").withColumn("start", F.col("start").cast("timestamp_ntz")).drop("batch")
    every = _lines(spark, sf).groupBy("service", "template", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("start")).agg(F.count("*").alias("n"))
    # the watermark is one for all keys, so a window is closed for all or for none
    return done.unionByName(every.join(done.select("start").distinct(), "start", "left_anti"))


def _arriving(lines: DataFrame, slices: int, late: bool) -> DataFrame:
    """Lines with the slice in which they arrive: by time, and, if ``late``, each fiftieth a slice behind its time."""
    ends = lines.agg(F.min(S.minute_number()).alias("a"), F.max(S.minute_number()).alias("b"))  # one row
    own = F.floor((S.minute_number() - F.col("a")) * slices / (F.col("b") - F.col("a") + 1))
    behind = ((F.col("event_id") % 50 == 0) & F.lit(late)).cast("int")
    return lines.join(F.broadcast(ends)).withColumn("slice", F.least(own + behind, F.lit(slices - 1)).cast("int")).drop("a", "b")


def _streamed(spark: SparkSession, rows: DataFrame, clock: minutes.MinuteClock, slices: int) -> None:
    """Each slice becomes a micro-batch of its own of a stream over the folder that it is written to."""
    names = [f.split()[0] for f in minutes.FEED.split(", ")]
    for i in range(slices):
        rows.filter(F.col("slice") == i).select(*names).write.mode("append").parquet(f"{clock.path}/feed")
        clock.run(spark.readStream.schema(minutes.FEED).parquet(f"{clock.path}/feed"), f"{clock.path}/checkpoint")


def _as_feed(lines: DataFrame, source) -> DataFrame:
    none = {"at": "bigint", "failed": "boolean", "upper": "timestamp_ntz", "caught_up": "boolean"}
    return lines.select(F.lit("line").alias("kind"), source.alias("source"), "event_id", "service", "template", "level", "lts", *(F.lit(None).cast(t).alias(n) for n, t in none.items()), "slice")


@query(ORACLES["x4_zero_fill"])
def x3_x4_stream_zero_fill(spark, sf):
    """The minutes that the stream closes, silent ones too, are those that the whole table gives."""
    clock = minutes.MinuteClock(spark, shared.folder(spark, "minutes"), now=0)
    lines = _lines(spark, sf)
    _streamed(spark, _as_feed(_arriving(lines, 3, False), F.lit("src")), clock, 3)
    last = lines.agg(F.max(S.minute_number())).first()[0]
    clock.finish(2, (last // 60 + 1) * 60)
    return clock.closed().filter(~F.col("key").startswith("*") | (F.col("minute") <= last)).select("service", "key", "day", "hour", "minute", "n")


@query(f"""WITH {S.LINES_SQL}, m AS (SELECT *, floor(epoch(lts) / 60)::BIGINT AS minute FROM lines), e AS (SELECT min(minute) AS a, max(minute) AS b FROM m),
l AS (SELECT m.*, least((minute - a) * 4 // (b - a + 1) + (event_id % 50 = 0)::INT, 3) AS slice, CASE WHEN event_id % 50 = 7 AND (minute - a) * 4 // (b - a + 1) = 0 THEN 'src1' ELSE 'src0' END AS source FROM m, e),
c AS (SELECT 1 AS slice, min(top) AS closed FROM (SELECT source, max(minute) AS top FROM l WHERE slice = 0 GROUP BY source)
  UNION ALL SELECT 2, max(minute) FROM l WHERE slice < 2 AND source = 'src0' UNION ALL SELECT 3, max(minute) FROM l WHERE slice < 3 AND source = 'src0'),
f AS (SELECT service, event_id, CASE WHEN event_id % 97 = 0 THEN 'malformed' WHEN service = 'svc2' THEN 'skipped_off' WHEN minute < closed THEN 'late' ELSE 'counted' END AS fate FROM l LEFT JOIN c USING (slice))
SELECT service, fate, sum(n)::BIGINT AS n FROM (SELECT service, fate, CASE WHEN event_id % 31 = 0 AND fate <> 'counted' THEN 2 ELSE 1 END AS n FROM f UNION ALL SELECT service, 'duplicate', 1 FROM f WHERE event_id % 31 = 0 AND fate = 'counted') GROUP BY ALL""")
def x1_x9_a23_stream_fates(spark, sf):
    """What becomes of each line: a source that fails stops holding the watermark, a line behind it is late and counted as such."""
    clock = minutes.MinuteClock(spark, shared.folder(spark, "minutes"), off=("svc2",), now=0)
    lines = _arriving(_lines(spark, sf), 4, True)
    twice = lines.unionByName(lines.filter("event_id % 31 = 0")).withColumn("template", F.when(F.col("event_id") % 97 != 0, F.col("template")))
    first = (F.col("slice") == 0) & (F.col("event_id") % 50 == 7)
    polls = spark.createDataFrame([("poll", "src1", i, True, 1) for i in range(3)], "kind string, source string, at bigint, failed boolean, slice int")
    feed = _as_feed(twice, F.when(first, "src1").otherwise("src0")).unionByName(polls, allowMissingColumns=True)
    _streamed(spark, feed, clock, 4)
    return clock.fates()


@query(ORACLES["x7_changes"])
def x6_stream_changes(spark, sf):
    """The state machine over a stream finds the changes that the batch form finds."""
    folder = shared.folder(spark, "stream")
    _stated(spark, sf).select("service", "key", "tick", "high").repartitionByRange(4, "tick").write.parquet(f"{folder}/ticks")
    stream = live.event_stream(spark, f"{folder}/ticks", files_each=100)
    live.replay(live.state_changes(stream), f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/out").select("service", "key", "at", "from_state", "to_state")
