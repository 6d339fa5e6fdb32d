"""Table form over events, conversations and the order tables: logs, chains, graphs, windows, induction."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import share
from ..operators import analytics, corpus, induction, stores
from ..sources.fixtures import values, values_sql
from .registry import query, table


def _share(a: str, b: str, digits: int = 6) -> str:
    s = 10**digits
    return f"floor(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0) * {s}.0::DOUBLE + 0.5) / {s}.0::DOUBLE"


@query("W5_hash_chain", """
WITH h AS (SELECT user_id, event_id, sha256(concat_ws('|', event_id, event_type, props)) AS hash FROM events)
SELECT event_id, hash, lag(hash) OVER w AS previous, CAST(row_number() OVER w AS INT) AS position FROM h WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""")
def hash_chain(spark, sf_dir):
    log = stores.chained(table(spark, sf_dir, "events"), "user_id", "event_id", F.concat_ws("|", "event_id", "event_type", "props").cast("binary"))
    return log.select("event_id", "hash", "previous", "position")


@query("E14_chain_breaks", """
WITH h AS (SELECT user_id, event_id, sha256(CAST(event_id AS VARCHAR)) AS hash FROM events),
c AS (SELECT user_id, event_id, hash, CASE WHEN event_id % 97 = 0 THEN 'tampered' ELSE lag(hash) OVER (PARTITION BY user_id ORDER BY event_id) END AS previous FROM h)
SELECT event_id FROM (SELECT event_id, previous, lag(hash) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM c) WHERE previous IS DISTINCT FROM before""")
def chain_breaks(spark, sf_dir):
    log = stores.chained(table(spark, sf_dir, "events"), "user_id", "event_id", F.col("event_id").cast("string").cast("binary"))
    bad = log.withColumn("previous", F.when(F.col("event_id") % 97 == 0, "tampered").otherwise(F.col("previous")))
    return stores.chain_breaks(bad, "user_id", "event_id").select("event_id")


@query("E12_active", """
SELECT event_id, event_type FROM events e WHERE event_id % 10 <> 9 AND NOT EXISTS (SELECT 1 FROM events r WHERE r.event_id % 10 = 9 AND r.event_id - 4 = e.event_id)""")
def active(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    retractions = e.where("event_id % 10 = 9").select((F.col("event_id") - 4).alias("target_id"), F.col("event_id").alias("seq"))
    return stores.active(e.where("event_id % 10 <> 9").withColumn("seq", F.col("event_id")), retractions, "event_id").select("event_id", "event_type")


@query("K2_append", """
WITH o AS (SELECT event_id, sha256(concat_ws('|', event_type, user_id)) AS content_hash FROM events), s AS (SELECT * FROM o WHERE event_id < 3000), n AS (SELECT * FROM o WHERE event_id >= 2900),
f AS (SELECT content_hash, min(event_id) AS event_id FROM n WHERE content_hash NOT IN (SELECT content_hash FROM s) GROUP BY content_hash)
SELECT content_hash FROM f""")
def append(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.sha2(F.concat_ws("|", "event_type", "user_id").cast("binary"), 256).alias("content_hash"))
    fresh, _ = stores.append(e.where("event_id < 3000"), e.where("event_id >= 2900"), name="event_id")
    return fresh.select("content_hash")


@query("W3_carried", """
SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS anchor FROM events""")
def carried(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("anchor", F.when(F.col("event_type") == "purchase", F.col("value")))
    return corpus.carried_forward(e, "anchor", "user_id", "event_id").select("event_id", "anchor")


@query("W2_previous_turn", """
SELECT conv_id, turn, role, lag(role) OVER w AS role_before, lag(length(text)) OVER w AS chars_before FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)""")
def previous_turn(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.lag("role").over(w).alias("role_before"), F.lag(F.length("text")).over(w).alias("chars_before"))


@query("F8_stride", "SELECT event_id, place FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS place FROM events) WHERE place % 50 = 0")
def stride(spark, sf_dir):
    return analytics.stride(table(spark, sf_dir, "events"), "event_id", 50).select("event_id", "place")


@query("A4_rollup", "SELECT event_type, user_id % 10 AS bucket, count(*) AS n, round(avg(value), 6) AS mean, min(event_id) AS first_event FROM events GROUP BY ROLLUP (event_type, user_id % 10)")
def rollup(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("bucket", F.col("user_id") % 10)
    return e.rollup("event_type", "bucket").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.min("event_id").alias("first_event"))


@query("A7_matrix", f"""
WITH c AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL)
SELECT p_brand, p_type, n, (sum(n) OVER r)::BIGINT AS row_total, {_share('n', 'sum(n) OVER r')} AS row_share, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_type) = 1 AS is_top FROM c WINDOW r AS (PARTITION BY p_brand)""")
def matrix(spark, sf_dir):
    return analytics.matrix(table(spark, sf_dir, "part"), "p_brand", "p_type")


@query("J10_phase_by_category", """
SELECT hour, event_type, count(n) AS n FROM (SELECT h.range AS hour, t.event_type FROM range(24) h, (SELECT DISTINCT event_type FROM events) t) g
LEFT JOIN (SELECT CAST(hour(ts) AS BIGINT) AS hour, event_type, event_id AS n FROM events) e USING (hour, event_type) GROUP BY ALL""")
def phase_by_category(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.hour("ts").cast("bigint").alias("hour"), "event_type")
    counts = e.groupBy("hour", "event_type").agg(F.count("*").alias("n"))
    # 24 hours by the declared event types
    grid = spark.range(24).select(F.col("id").alias("hour")).crossJoin(F.broadcast(e.select("event_type").distinct()))
    return grid.join(counts, ["hour", "event_type"], "left").select("hour", "event_type", F.coalesce("n", F.lit(0)).alias("n"))


_EDGES = "SELECT DISTINCT a, b FROM (SELECT l_partkey AS a, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS b FROM lineitem) WHERE b IS NOT NULL AND a <> b"


def _edges(spark, sf_dir):
    return analytics.transitions(table(spark, sf_dir, "lineitem"), "l_orderkey", ["l_linenumber", "l_partkey"], "l_partkey")


@query("A5_reciprocity", f"WITH e AS ({_EDGES}) SELECT count(*) AS edges, count(r.a) AS reciprocal, {_share('count(r.a)', 'count(*)')} AS rate FROM e LEFT JOIN e r ON e.a = r.b AND e.b = r.a")
def reciprocity(spark, sf_dir):
    return analytics.reciprocity(_edges(spark, sf_dir))


@query("J7_mutual_edges", f"WITH e AS ({_EDGES}) SELECT a, b FROM e WHERE EXISTS (SELECT 1 FROM e r WHERE r.a = e.b AND r.b = e.a)")
def mutual_edges(spark, sf_dir):
    e = _edges(spark, sf_dir).distinct()
    return e.join(e.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_semi")


@query("A6_permutation_null", f"""
WITH e AS ({_EDGES}), t AS (SELECT trial, a, b FROM e, (SELECT unnest(range(1, 9)) AS trial)),
ra AS (SELECT trial, a, row_number() OVER (PARTITION BY trial ORDER BY sha256(concat_ws('|', a, b))) AS r FROM t), rb AS (SELECT trial, b, row_number() OVER (PARTITION BY trial ORDER BY sha256(concat_ws('|', trial, a, b, 'null'))) AS r FROM t),
m AS (SELECT DISTINCT trial, a, b FROM ra JOIN rb USING (trial, r))
SELECT CAST(m.trial AS INT) AS trial, count(*) AS edges, count(x.a) AS reciprocal FROM m LEFT JOIN m x ON x.trial = m.trial AND x.a = m.b AND x.b = m.a GROUP BY m.trial""")
def permutation_null(spark, sf_dir):
    return analytics.permutation_null(_edges(spark, sf_dir), 8)


@query("A6_null_summary", f"""
WITH e AS ({_EDGES}), t AS (SELECT trial, a, b FROM e, (SELECT unnest(range(1, 9)) AS trial)),
ra AS (SELECT trial, a, row_number() OVER (PARTITION BY trial ORDER BY sha256(concat_ws('|', a, b))) AS r FROM t), rb AS (SELECT trial, b, row_number() OVER (PARTITION BY trial ORDER BY sha256(concat_ws('|', trial, a, b, 'null'))) AS r FROM t),
m AS (SELECT DISTINCT trial, a, b FROM ra JOIN rb USING (trial, r)),
n AS (SELECT m.trial, {_share('count(x.a)', 'count(*)')} AS rate FROM m LEFT JOIN m x ON x.trial = m.trial AND x.a = m.b AND x.b = m.a GROUP BY m.trial),
o AS (SELECT {_share('count(r.a)', 'count(*)')} AS rate FROM e LEFT JOIN e r ON e.a = r.b AND e.b = r.a)
SELECT any_value(o.rate) AS observed, count(*) AS trials, round(avg(n.rate), 6) AS mean, min(n.rate) AS least, max(n.rate) AS greatest, count(*) FILTER (n.rate < o.rate) AS below FROM n, o""")
def null_summary(spark, sf_dir):
    """The observed rate among those of the null: its mean, least and greatest, and how many trials are below."""
    edges = _edges(spark, sf_dir).distinct()
    null = analytics.permutation_null(edges, 8).select(share(F.col("reciprocal"), F.col("edges")).alias("rate"))
    seen = analytics.reciprocity(edges).select(F.col("rate").alias("observed"))  # one row
    both = null.crossJoin(F.broadcast(seen))
    return both.agg(F.first("observed").alias("observed"), F.count("*").alias("trials"), F.round(F.avg("rate"), 6).alias("mean"), F.min("rate").alias("least"), F.max("rate").alias("greatest"), F.count_if(F.col("rate") < F.col("observed")).alias("below"))


_PREFIXES = [("pur", "revenue"), ("c", "attention"), ("v", "attention"), ("s", "access")]


@query("J15_prefix_join", f"SELECT gate, count(*) AS n FROM events JOIN (SELECT * FROM {values_sql(['prefix', 'gate'], _PREFIXES)}) p ON starts_with(event_type, prefix) GROUP BY gate")
def prefix_join(spark, sf_dir):
    rules = F.broadcast(values(spark, "prefix string, gate string", _PREFIXES))
    e = table(spark, sf_dir, "events")
    return e.join(rules, F.startswith(e["event_type"], F.col("prefix"))).groupBy("gate").agg(F.count("*").alias("n"))


@query("A28_payload_keys", "SELECT event_type, key, count(*) AS n FROM (SELECT event_type, unnest(json_keys(props)) AS key FROM events) GROUP BY ALL")
def payload_keys(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_type", F.explode(F.json_object_keys("props")).alias("key")).groupBy("event_type", "key").agg(F.count("*").alias("n"))


_LADDER = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("A22_weakest_rung", "SELECT o_custkey, max(o_orderpriority) AS weakest, count(*) AS claims FROM orders GROUP BY o_custkey")
def weakest_rung(spark, sf_dir):
    rung = F.array_position(F.array(*map(F.lit, _LADDER)), F.col("o_orderpriority"))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by("o_orderpriority", rung).alias("weakest"), F.count("*").alias("claims"))


@query("U2_disjoint", "SELECT 'doc_id in labels and events' AS check, count(*) AS shared FROM (SELECT doc_id FROM labels INTERSECT SELECT event_id FROM events)")
def disjoint(spark, sf_dir):
    both = table(spark, sf_dir, "labels").select("doc_id").intersect(table(spark, sf_dir, "events").select("event_id"))
    return both.agg(F.lit("doc_id in labels and events").alias("check"), F.count("*").alias("shared"))


@query("U3_differences", """
SELECT n_name AS name, 'only-nation' AS side FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 8000)
UNION ALL SELECT 'supplier ' || s_suppkey, 'only-supplier' FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_nationkey < 20)""")
def differences(spark, sf_dir):
    n, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    rich = s.where("s_acctbal > 8000").select(F.col("s_nationkey").alias("n_nationkey"))
    left = n.join(rich, "n_nationkey", "left_anti").select(F.col("n_name").alias("name"), F.lit("only-nation").alias("side"))
    right = s.join(n.where("n_nationkey < 20"), s["s_nationkey"] == n["n_nationkey"], "left_anti").select(F.concat(F.lit("supplier "), "s_suppkey"), F.lit("only-supplier"))
    return left.union(right)


_CTX = "user_id % 7 AS u, dayofweek(ts) AS d, hour(ts) // 6 AS q"
_LABEL = "CASE WHEN (user_id % 7 + dayofweek(ts)) % 3 = 0 THEN 'x' WHEN user_id % 7 = 5 AND hour(ts) % 2 = 0 THEN 'z' ELSE 'y' END"


def _examples(spark, sf_dir):
    d = F.dayofweek("ts") - 1
    u = F.col("user_id") % 7
    label = F.when((u + d) % 3 == 0, "x").when((u == 5) & (F.hour("ts") % 2 == 0), "z").otherwise("y")
    return table(spark, sf_dir, "events").select("event_id", u.alias("u"), d.alias("d"), F.floor(F.hour("ts") / 6).alias("q"), label.alias("label"))


_PREDICT = """
WITH e AS (SELECT event_id, {ctx}, {label} AS label FROM events WHERE event_id % 4 <> 3),
conflict AS (SELECT u, d, q FROM e GROUP BY ALL HAVING count(DISTINCT label) > 1), usable AS (SELECT * FROM e ANTI JOIN conflict USING (u, d, q)),
h0 AS (SELECT u, d, min(label) AS l, count(DISTINCT label) AS n FROM usable GROUP BY ALL), h1 AS (SELECT u, min(label) AS l, count(DISTINCT label) AS n FROM usable GROUP BY ALL), h2 AS (SELECT u, d, q, min(label) AS l, count(DISTINCT label) AS n FROM usable GROUP BY ALL),
alive AS (SELECT coalesce((SELECT max(n) FROM h0), 0) <= 1 AS a0, coalesce((SELECT max(n) FROM h1), 0) <= 1 AS a1, coalesce((SELECT max(n) FROM h2), 0) <= 1 AS a2),
qs AS (SELECT DISTINCT {ctx} FROM events WHERE event_id % 4 = 3),
v AS (SELECT qs.u, qs.d, qs.q, a0::INT + a1::INT + a2::INT AS n, list_filter([CASE WHEN a0 THEN h0.l END, CASE WHEN a1 THEN h1.l END, CASE WHEN a2 THEN h2.l END], lambda x: x IS NOT NULL) AS got, c.u IS NOT NULL AS contested
FROM qs CROSS JOIN alive LEFT JOIN h0 ON h0.u = qs.u AND h0.d = qs.d LEFT JOIN h1 ON h1.u = qs.u LEFT JOIN h2 ON h2.u = qs.u AND h2.d = qs.d AND h2.q = qs.q LEFT JOIN conflict c ON c.u = qs.u AND c.d = qs.d AND c.q = qs.q)
SELECT u, d, q, CASE WHEN contested THEN 'Contested' WHEN n > 0 AND len(got) = n AND len(list_distinct(got)) = 1 THEN 'CandidateReading' ELSE 'Unknown' END AS status,
CASE WHEN contested OR (n > 0 AND len(got) = n AND len(list_distinct(got)) = 1) THEN NULL WHEN n = 0 THEN 'hypothesis-family-refuted' WHEN len(got) < n THEN 'uncovered-context' ELSE 'surviving-hypotheses-disagree' END AS reason,
CASE WHEN NOT contested AND n > 0 AND len(got) = n AND len(list_distinct(got)) = 1 THEN got[1] END AS prediction FROM v"""


@query("E15_induction", _PREDICT.format(ctx=_CTX, label=_LABEL))
def induced(spark, sf_dir):
    rows = _examples(spark, sf_dir)
    q = rows.where("event_id % 4 = 3").select("u", "d", "q").distinct()
    return induction.predicted(q, rows.where("event_id % 4 <> 3"), ["u", "d", "q"], [["u", "d"], ["u"], ["u", "d", "q"]], "label")


@query("E15_fuel", f"""
WITH e AS (SELECT event_id, {_CTX}, {_LABEL} AS label FROM events),
r AS (SELECT 0 AS hypothesis, event_id, label, first_value(label) OVER (PARTITION BY u, d ORDER BY event_id) AS f FROM e UNION ALL SELECT 1, event_id, label, first_value(label) OVER (PARTITION BY u ORDER BY event_id) FROM e UNION ALL SELECT 2, event_id, label, first_value(label) OVER (PARTITION BY u, d, q ORDER BY event_id) FROM e),
n AS (SELECT hypothesis, label <> f AS clash, row_number() OVER (PARTITION BY hypothesis ORDER BY event_id) AS n FROM r),
c AS (SELECT hypothesis, coalesce(min(n) FILTER (clash), count(*)) AS checks, bool_or(clash) AS refuted FROM n GROUP BY hypothesis),
s AS (SELECT *, (sum(checks) OVER (ORDER BY hypothesis) - checks)::BIGINT AS spent_before FROM c)
SELECT hypothesis, checks, refuted, spent_before, spent_before + checks > 5000 AS exhausted FROM s""")
def fuel(spark, sf_dir):
    return induction.charged(_examples(spark, sf_dir), [["u", "d"], ["u"], ["u", "d", "q"]], "label", "event_id", 5000)


@query("A19_held_out", f"""
WITH p AS (SELECT event_id, {_LABEL} AS label, CASE WHEN user_id % 7 <> 5 THEN CASE WHEN (user_id % 7 + dayofweek(ts)) % 3 = 0 THEN 'x' ELSE 'y' END END AS predicted FROM events)
SELECT count(*) AS total, count(predicted) AS answered, count(*) FILTER (predicted = label) AS correct, {_share('count(predicted)', 'count(*)')} AS coverage, {_share('count(*) FILTER (predicted = label)', 'count(predicted)')} AS accuracy, count(*) FILTER (predicted <> label) AS wrong FROM p""")
def held_out(spark, sf_dir):
    rows = _examples(spark, sf_dir)
    rows = rows.withColumn("predicted", F.when(F.col("u") != 5, F.when((F.col("u") + F.col("d")) % 3 == 0, "x").otherwise("y")))
    return analytics.scored(rows, "label", "predicted")


@query("A25_tolerance", """
WITH p AS (SELECT p_partkey, log2(p_retailprice) - floor(log2(p_retailprice)) AS x FROM part WHERE p_retailprice > 0),
t AS (SELECT k, k / 22.0::DOUBLE AS y FROM range(22) r(k))
SELECT CAST(k AS INT) AS target, count(*) FILTER (least(abs(x - y), 1 - abs(x - y)) <= 0.005) AS covered FROM p, t GROUP BY k""")
def tolerance(spark, sf_dir):
    p = table(spark, sf_dir, "part").where("p_retailprice > 0").select((F.log2("p_retailprice") - F.floor(F.log2("p_retailprice"))).alias("x"))
    near = lambda k: F.least(F.abs(F.col("x") - F.lit(k / 22)), 1 - F.abs(F.col("x") - F.lit(k / 22))) <= 0.005
    one = p.agg(*[F.count_if(near(k)).alias(f"t{k}") for k in range(22)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("target"), F.col(f"t{k}").alias("covered")) for k in range(22)])).alias("r")).select("r.*")


@query("J8_unmatched", f"SELECT c_mktsegment, count(*) AS customers, {_share('count(*)', '(SELECT count(*) FROM customer)')} AS part_of_all FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 200000) GROUP BY c_mktsegment")
def unmatched(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    total = c.agg(F.count("*").alias("total"))
    left = c.join(table(spark, sf_dir, "orders").where("o_orderstatus = 'F' and o_totalprice > 200000"), c["c_custkey"] == F.col("o_custkey"), "left_anti").groupBy("c_mktsegment").agg(F.count("*").alias("customers"))
    return left.crossJoin(F.broadcast(total)).select("c_mktsegment", "customers", share(F.col("customers"), F.col("total")).alias("part_of_all"))
