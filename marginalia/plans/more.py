"""Identities, set relations, samples, withdrawals and smaller parsers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import share, u16len
from ..operators import analytics, finite, relations, stores
from ..sources.fixtures import values, values_sql
from .fixtures import _HOLD, _training
from .registry import query, table


@query("U4_partition_identity", """
WITH r AS (SELECT coalesce(quality = 1, false) AS core, coalesce(quality = 0, false) AS held_out, l.doc_id IS NULL AND lang IS NOT NULL AS out_of_grammar, l.doc_id IS NULL AND lang IS NULL AS excluded FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l USING (doc_id)),
n AS (SELECT *, core::INT + held_out::INT + out_of_grammar::INT + excluded::INT AS n FROM r)
SELECT count(*) AS pool, count(*) FILTER (core) AS core, count(*) FILTER (held_out) AS held_out, count(*) FILTER (out_of_grammar) AS out_of_grammar, count(*) FILTER (excluded) AS excluded, count(*) FILTER (n > 1) AS twice, count(*) FILTER (n = 0) AS nowhere, count(*) FILTER (n <> 1) = 0 AS holds FROM n""")
def partition_identity(spark, sf_dir):
    """Documents by four conditions of their own: whether each is in one class, rather than whether the counts add up."""
    marks = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.lit(True).alias("there"))
    d = table(spark, sf_dir, "documents").select("doc_id", "lang").join(marks, "doc_id", "left")
    classes = {
        "core": F.coalesce(F.col("quality") == 1, F.lit(False)), "held_out": F.coalesce(F.col("quality") == 0, F.lit(False)),
        "out_of_grammar": F.col("there").isNull() & F.col("lang").isNotNull(), "excluded": F.col("there").isNull() & F.col("lang").isNull(),
    }
    n = sum(c.cast("int") for c in classes.values())
    one = d.agg(F.count("*").alias("pool"), *[F.count_if(c).alias(k) for k, c in classes.items()], F.count_if(n > 1).alias("twice"), F.count_if(n == 0).alias("nowhere"))
    return one.withColumn("holds", F.col("twice") + F.col("nowhere") == 0)


@query("U5_distinct_values", "SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def distinct_values(spark, sf_dir):
    return table(spark, sf_dir, "events").dropDuplicates(["event_type", "user_id"]).groupBy("event_type").agg(F.count("*").alias("users"))


@query("U6_set_equality", "SELECT a.lang AS a, b.lang AS b, a.s = b.s AS same FROM (SELECT lang, list(DISTINCT source ORDER BY source) AS s FROM documents GROUP BY lang) a JOIN (SELECT lang, list(DISTINCT source ORDER BY source) AS s FROM documents GROUP BY lang) b ON a.lang < b.lang")
def set_equality(spark, sf_dir):
    """Equal sets have as many members, and as many in common: no list of members is gathered."""
    d = table(spark, sf_dir, "documents").select("lang", "source").distinct()
    n = d.groupBy("lang").agg(F.count("*").alias("n"))
    a, b = n.select(F.col("lang").alias("a"), F.col("n").alias("na")), n.select(F.col("lang").alias("b"), F.col("n").alias("nb"))
    common = d.select(F.col("lang").alias("a"), "source").join(d.select(F.col("lang").alias("b"), "source"), "source").where("a < b").groupBy("a", "b").agg(F.count("*").alias("both"))
    pairs = a.join(b, F.col("a") < F.col("b")).join(common, ["a", "b"], "left")  # languages, a declared dimension
    return pairs.select("a", "b", (F.coalesce("both", F.lit(0)).eqNullSafe(F.col("na")) & (F.col("na") == F.col("nb"))).alias("same"))


@query("V16_rebuild_equality", "SELECT 0 AS only_stored, 0 AS only_rebuilt, true AS equal")
def rebuild_equality(spark, sf_dir):
    """The ternary catalog as built, and as decoded again from its addresses."""
    built = finite.addresses(spark).select("head", "zan")
    again = finite.addresses(spark).select(finite.decoded(F.col("address")).alias("d")).select("d.head", "d.zan")
    a, b = built.exceptAll(again).agg(F.count("*").cast("int").alias("only_stored")), again.exceptAll(built).agg(F.count("*").cast("int").alias("only_rebuilt"))
    return a.crossJoin(F.broadcast(b)).withColumn("equal", (F.col("only_stored") == 0) & (F.col("only_rebuilt") == 0))


@query("X4_catalog_gates", "SELECT * FROM (VALUES ('words', 64::BIGINT, true), ('names', 63::BIGINT, false), ('ordinals', 64::BIGINT, true)) t(gate, n, holds)")
def catalog_gates(spark, sf_dir):
    """A catalog of 64 entries in which one name stands twice."""
    c = finite.words(spark).select("bits", F.col("code").alias("ordinal"), F.concat(F.lit("n"), F.when(F.col("code") == 63, 62).otherwise(F.col("code"))).alias("name"))
    one = c.agg(F.count_distinct("bits").alias("words"), F.count_distinct("name").alias("names"), F.count_distinct("ordinal").alias("ordinals"))
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("gate"), F.col(k).alias("n"), (F.col(k) == 64).alias("holds")) for k in ("words", "names", "ordinals")])).alias("g")).select("g.*")


@query("E18_withdrawal", "SELECT id, 'KnownFiniteGrammar' AS before, CASE WHEN id LIKE '%receive' THEN 'Unknown' ELSE 'KnownFiniteGrammar' END AS after FROM " + values_sql(["id"], [(i,) for i, _, _ in _HOLD]))
def withdrawal(spark, sf_dir):
    """What is read with all evidence, and once the example of one construction is withdrawn."""
    rows, train = values(spark, "id string, text string, expected array<string>", _HOLD).select("id", "text"), _training(spark)
    before = relations.read(rows, relations.learned_state(train)).select("id", F.col("status").alias("before"))
    return before.join(relations.read(rows, relations.learned_state(train.where("id <> 'train-2'"))).select("id", F.col("status").alias("after")), "id")


@query("E13_retraction_preview", """
WITH a AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS k FROM events), b AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS k FROM events WHERE event_id % 5 <> 0)
SELECT event_type, count(*) FILTER (b.event_id IS NULL) AS leaves FROM (SELECT * FROM a WHERE k <= 10) a LEFT JOIN (SELECT * FROM b WHERE k <= 10) b USING (event_type, event_id) GROUP BY event_type""")
def retraction_preview(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    order = [F.desc("value"), F.col("event_id")]
    before = analytics.core(e, "event_type", order, 10).select("event_type", "event_id")
    gone = e.where("event_id % 5 = 0").select(F.col("event_id").alias("target_id"), (F.col("event_id") + 1).alias("seq"))
    after = analytics.core(stores.active(e.withColumn("seq", F.col("event_id")), gone, "event_id"), "event_type", order, 10).select("event_id", F.lit(True).alias("stays"))
    return before.join(after, "event_id", "left").groupBy("event_type").agg(F.count_if(F.col("stays").isNull()).alias("leaves"))


@query("C20_short_passages", "SELECT lang, count(*) AS passages, count(*) FILTER (length(p) <= 4) AS short FROM (SELECT lang, unnest(string_split(text, chr(10))) AS p FROM documents) GROUP BY lang")
def short_passages(spark, sf_dir):
    p = table(spark, sf_dir, "documents").select("lang", F.explode(F.split("text", "\n")).alias("p"))
    return p.groupBy("lang").agg(F.count("*").alias("passages"), F.count_if(F.length("p") <= 4).alias("short"))


@query("C11_counts", r"SELECT doc_id, len(regexp_extract_all(text, '[.]')) AS stops, len(regexp_extract_all(text, '[A-Z][a-z]+')) AS capitals FROM documents")
def counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_count("text", F.lit("[.]")).alias("stops"), F.regexp_count("text", F.lit("[A-Z][a-z]+")).alias("capitals"))


_UNITS = [("a", "abc"), ("b", "子曰"), ("c", "𝌆中"), ("d", ""), ("e", None)]


@query("F1_length_bounds", "SELECT * FROM (VALUES ('a', 3, 3), ('b', 2, 2), ('c', 3, 2), ('d', 0, 0), ('e', NULL, NULL)) t(id, units, points)")
def length_bounds(spark, sf_dir):
    return values(spark, "id string, text string", _UNITS).select("id", u16len(F.col("text")).alias("units"), F.length("text").alias("points"))


@query("F9_stratified", "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents WHERE length(text) >= 12) WHERE k <= 3")
def stratified(spark, sf_dir):
    return analytics.core(table(spark, sf_dir, "documents").where("length(text) >= 12").select("source", "doc_id"), "source", [F.col("doc_id")], 3).select("source", "doc_id")


@query("J6_mates", "SELECT least(a.o_orderkey, b.o_orderkey) AS a, greatest(a.o_orderkey, b.o_orderkey) AS b, a.o_orderstatus = b.o_orderstatus AS same FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1 WHERE a.o_orderkey % 2 = 0")
def mates(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    pair = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey")).otherwise(F.col("o_orderkey") - 1)
    p = o.groupBy(pair.alias("a")).agg(F.max("o_orderkey").alias("b"), F.count("*").alias("n"), (F.min("o_orderstatus") == F.max("o_orderstatus")).alias("same"))
    return p.where("n = 2").select("a", "b", "same")


@query("J14_triage", f"WITH g AS (SELECT * FROM {values_sql(['source', 'grp'], [('src0', 'core'), ('src1', 'core'), ('src2', 'late')])}) SELECT coalesce(grp, 'lang:' || lang) AS grp, count(*) AS n FROM documents LEFT JOIN g USING (source) GROUP BY 1")
def triage(spark, sf_dir):
    g = F.broadcast(values(spark, "source string, grp string", [("src0", "core"), ("src1", "core"), ("src2", "late")]))
    d = table(spark, sf_dir, "documents").join(g, "source", "left")
    return d.groupBy(F.coalesce("grp", F.concat(F.lit("lang:"), "lang")).alias("grp")).agg(F.count("*").alias("n"))


@query("W8_successor", "SELECT l_orderkey, l_linenumber, lead(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS next_line FROM lineitem")
def successor(spark, sf_dir):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.lead("l_linenumber").over(w).alias("next_line"))


@query("W9_ranked_yield", "SELECT l_partkey, n, rate FROM (SELECT l_partkey, count(*) AS n, floor(count(*) FILTER (l_returnflag = 'R')::DOUBLE / count(*) * 1000000.0::DOUBLE + 0.5) / 1000000.0::DOUBLE AS rate FROM lineitem GROUP BY l_partkey HAVING count(*) >= 30) ORDER BY rate DESC, l_partkey LIMIT 50")
def ranked_yield(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"), share(F.count_if(F.col("l_returnflag") == "R"), F.count("*")).alias("rate")).where("n >= 30")
    return analytics.top(r, 50, "rate", "l_partkey")


@query("R14_decoded_features", "SELECT phase_group, phase_within, count(*) AS n FROM (SELECT (z - 1) // 3 AS phase_group, (z - 1) % 3 AS phase_within FROM range(81) h, (SELECT unnest(range(1, 10)) AS z)) GROUP BY ALL")
def decoded_features(spark, sf_dir):
    return finite.addresses(spark).groupBy("phase_group", "phase_within").agg(F.count("*").alias("n"))


@query("S10_prefix_listing", "SELECT page_id, url FROM pages WHERE starts_with(url, 'http')")
def prefix_listing(spark, sf_dir):
    return table(spark, sf_dir, "pages").where(F.col("url").startswith("http")).select("page_id", "url")
