"""Gates with floors and what reads through them, declared conflations, and blind scores by arm, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import tokens
from ..operators import blind, dependencies, gates, validation
from .registry import query, table

# fixed values: languages that are declared, and the frame whose reach is measured
_LANGS = ["en", "de", "fr", "es"]
_FRAME = '[A-Za-z_]+ [=:] "'


def _gate_results(spark, sf_dir):
    """labels is the store of records, documents the corpus, languages the constructions."""
    floor = gates.FLOORS
    labels = table(spark, sf_dir, "labels")
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.lit(True).alias("labelled"))
    d = table(spark, sf_dir, "documents").join(marks, "doc_id", "full_outer")
    there, labelled = F.col("text").isNotNull() | F.col("lang").isNotNull() | F.col("n_chars").isNotNull(), F.coalesce("labelled", F.lit(False))
    d = d.select("doc_id", "lang", "toxic", there.alias("there"), labelled.alias("labelled"), (F.trim(F.coalesce("text", F.lit(""))) == "").alias("blank"), F.coalesce(F.col("text").rlike(_FRAME), F.lit(False)).alias("read"))
    store = labels.agg(F.count("*").alias("records"), F.count_distinct("doc_id").alias("ids"))
    # leave one out: the others of the language agree with the record's label by majority
    of_lang = d.where("there and lang is not null").groupBy("lang").agg(F.count_if(F.col("labelled") & (F.col("toxic") == 1)).alias("n1"), F.count_if(F.col("labelled") & (F.col("toxic") == 0)).alias("n0"))
    n0, n1 = F.col("n0"), F.col("n1")
    langs = of_lang.agg(
        F.count("*").alias("langs"), F.count_if(n0 + n1 >= floor["labelled-per-construction-determination"]).alias("determined"),
        F.coalesce(F.sum(F.when(n1 - 1 > n0, n1).otherwise(0) + F.when(n0 - 1 > n1, n0).otherwise(0)), F.lit(0)).alias("right"),
        F.coalesce(F.sum(n0 + n1), F.lit(0)).alias("held_out"),
    )
    corpus = d.agg(
        F.count_if("there").alias("documents"), F.count_if(F.col("there") & F.col("blank")).alias("blank"), F.count_if(F.col("there") & F.col("blank") & ~F.col("read")).alias("closed"),
        F.count_if(F.col("there") & F.col("read")).alias("read"), F.count_if("labelled").alias("marked"), F.count_if(F.col("there") & F.col("labelled")).alias("sourced"),
        F.count_if(F.col("there") & (F.col("lang").isNull() | F.col("lang").isin(_LANGS))).alias("declared"),
        F.count_if(F.col("there") & F.col("labelled") & F.col("lang").isNotNull()).alias("core"), F.count_if(F.col("there") & ~F.col("labelled") & F.col("lang").isNotNull()).alias("out"), F.count_if(F.col("there") & F.col("lang").isNull()).alias("unread"),
    )
    one = corpus.crossJoin(F.broadcast(store)).crossJoin(F.broadcast(langs))  # one row each
    c = F.col
    return gates.measured(one, {
        "G1": (c("ids"), c("records"), 1), "G2": (c("determined"), c("langs"), 1), "G3": (c("right"), c("held_out"), 1), "G4": (c("closed"), c("blank"), 1),
        "G5": (c("read"), c("documents"), floor["corpus-coverage-rate"]), "G6": (c("sourced"), c("marked"), 1), "G7": (c("declared"), c("documents"), 1),
        "G8": (c("sourced"), c("documents"), floor["g8-corpus-answerability"]), "G9": (c("core") + c("out") + c("unread"), c("documents"), 1),
    })


def _reads(spark):
    return spark.createDataFrame([(g, d) for g, *_, reads in gates.declared() for d in reads], "`from` string, `to` string")


_GATES_SQL = f"""
m AS (SELECT doc_id, max(toxic) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
d AS (SELECT lang, toxic, d.doc_id IS NOT NULL AS there, m.doc_id IS NOT NULL AS labelled, trim(coalesce(text, '')) = '' AS blank, coalesce(regexp_matches(text, '{_FRAME}'), false) AS hit FROM documents d FULL JOIN m USING (doc_id)),
l AS (SELECT lang, count(*) FILTER (labelled AND toxic = 1) AS n1, count(*) FILTER (labelled AND toxic = 0) AS n0 FROM d WHERE there AND lang IS NOT NULL GROUP BY lang),
g AS (
SELECT 'G1' AS gate, (SELECT count(DISTINCT doc_id) FROM labels) AS reached, (SELECT count(*) FROM labels) AS n, 1.0::DOUBLE AS floor
UNION ALL SELECT 'G2', count(*) FILTER (n0 + n1 >= 2), count(*), 1.0 FROM l
UNION ALL SELECT 'G3', sum(CASE WHEN n1 - 1 > n0 THEN n1 ELSE 0 END + CASE WHEN n0 - 1 > n1 THEN n0 ELSE 0 END)::BIGINT, sum(n0 + n1)::BIGINT, 1.0 FROM l
UNION ALL SELECT 'G4', count(*) FILTER (there AND blank AND NOT hit), count(*) FILTER (there AND blank), 1.0 FROM d
UNION ALL SELECT 'G5', count(*) FILTER (there AND hit), count(*) FILTER (there), 0.01 FROM d
UNION ALL SELECT 'G6', count(*) FILTER (there AND labelled), count(*) FILTER (labelled), 1.0 FROM d
UNION ALL SELECT 'G7', count(*) FILTER (there AND (lang IS NULL OR lang IN ({', '.join(repr(x) for x in _LANGS)}))), count(*) FILTER (there), 1.0 FROM d
UNION ALL SELECT 'G8', count(*) FILTER (there AND labelled), count(*) FILTER (there), 0.15 FROM d
UNION ALL SELECT 'G9', count(*) FILTER (there AND labelled AND lang IS NOT NULL) + count(*) FILTER (there AND NOT labelled AND lang IS NOT NULL) + count(*) FILTER (there AND lang IS NULL), count(*) FILTER (there), 1.0 FROM d),
p AS (SELECT gate, reached, n AS "of", floor, CASE WHEN n > 0 THEN reached >= n * floor END AS passes FROM g),
r(f, t) AS (SELECT * FROM (VALUES {', '.join(f"('{g}', '{d}')" for g, *_, reads in gates.GATES for d in reads)})),
far(f, t) AS (SELECT f, t FROM r UNION SELECT far.f, r.t FROM far JOIN r ON r.f = far.t)"""
_ABOUT = ", ".join(f"('{g}', {str(need).lower()}, '{kind}', '{rung}')" for g, need, kind, rung, _ in gates.GATES)


@query("E19_gates", f"""WITH RECURSIVE {_GATES_SQL},
s AS (SELECT p.*, coalesce(passes, false) AND NOT EXISTS (SELECT 1 FROM far JOIN p q ON q.gate = far.t WHERE far.f = p.gate AND NOT coalesce(q.passes, false)) AS stands FROM p)
SELECT s.gate, required, support, rung, reached, "of", floor, passes, stands, CASE WHEN passes IS NULL THEN 'unmeasured' WHEN NOT passes THEN 'fails' WHEN stands THEN 'passes' ELSE 'meaningless' END AS state
FROM s JOIN (VALUES {_ABOUT}) a(gate, required, support, rung) USING (gate)""")
def gate_report(spark, sf_dir):
    about = spark.createDataFrame([g[:4] for g in gates.declared()], "gate string, required boolean, support string, rung string")
    return gates.standing(_gate_results(spark, sf_dir), _reads(spark)).join(about, "gate").select("gate", "required", "support", "rung", "reached", "of", "floor", "passes", "stands", "state")


@query("E19_reopened", f"WITH RECURSIVE {_GATES_SQL} SELECT p.gate, far.f AS reopens FROM p JOIN far ON far.t = p.gate WHERE NOT passes AND far.f <> p.gate")
def gates_reopened(spark, sf_dir):
    """Which gates open again as others fail; a raised floor on G2 would open G3, G8 and G9."""
    return gates.reopened(_gate_results(spark, sf_dir), _reads(spark))


@query("E19_minima", """WITH RECURSIVE e AS (SELECT DISTINCT o_custkey AS f, o_custkey // 2 AS t, o_totalprice AS price FROM orders), v AS (SELECT f AS id, min(price) AS price FROM e GROUP BY f),
n AS (SELECT id FROM v UNION SELECT f // 2 FROM e), w(id, far) AS (SELECT id, id FROM n UNION SELECT w.id, w.far // 2 FROM w JOIN v ON v.id = w.far)
SELECT w.id, w.id AS component, min(price) AS least FROM w LEFT JOIN v ON v.id = w.far GROUP BY w.id""")
def minima(spark, sf_dir):
    """The fixpoint over a graph as large as a table: each customer reads through the one of half its number; the least price along the way."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.floor(F.col("o_custkey") / 2).alias("to"), F.col("o_totalprice").alias("least"))
    own = o.groupBy("id").agg(F.min("least").alias("least"))
    nodes = own.union(o.select("to", F.lit(None).cast("double")).distinct()).groupBy("id").agg(F.min("least").alias("least"))
    edges = o.select(F.col("id").alias("from"), "to").distinct()
    return gates.minima(nodes, edges, "least").select("id", "component", "least")


def _lattice(name: str, attributes: list[str], most: int = 2) -> str:
    from itertools import combinations

    parts = []
    for size in range(1, most + 1):
        for by in combinations(attributes, size):
            have = " AND ".join(f"{a} IS NOT NULL" for a in by)
            for a in attributes:
                if a not in by:
                    parts.append(f"SELECT '{','.join(by)}' AS determinant, '{a}' AS dependent, count(*) FILTER (n > 1) AS tested, count(*) FILTER (lo <> hi) AS broken, min(w) FILTER (lo <> hi) AS witness FROM (SELECT concat_ws('|', {', '.join(by)}) AS w, count({a}) AS n, min({a}) AS lo, max({a}) AS hi FROM t WHERE {have} GROUP BY {', '.join(by)})")
    return f"SELECT determinant, dependent, tested, broken, CASE WHEN tested > 0 THEN broken = 0 END AS holds, witness FROM ({' UNION ALL '.join(parts)})"


_ORDER_ATTRIBUTES = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "day"]
_TEXT_ATTRIBUTES = ["doc_id", "lang", "source", "n_chars", "digest"]


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(*_ORDER_ATTRIBUTES[:4], F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


def _texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(*_TEXT_ATTRIBUTES[:4], F.md5("text").alias("digest"))


_ORDERS_SQL = f"t AS (SELECT {', '.join(_ORDER_ATTRIBUTES[:4])}, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders)"
_TEXTS_SQL = f"t AS (SELECT {', '.join(_TEXT_ATTRIBUTES[:4])}, md5(text) AS digest FROM documents)"


@query("V11_order_dependencies", f"WITH {_ORDERS_SQL} {_lattice('t', _ORDER_ATTRIBUTES)}")
def order_dependencies(spark, sf_dir):
    return dependencies.verdicts(_orders(spark, sf_dir), _ORDER_ATTRIBUTES)


@query("V11_text_dependencies", f"WITH {_TEXTS_SQL} {_lattice('t', _TEXT_ATTRIBUTES)}")
def text_dependencies(spark, sf_dir):
    return dependencies.verdicts(_texts(spark, sf_dir), _TEXT_ATTRIBUTES)


_CLAIMS = [
    ("C1", "digest", "lang", True), ("C2", "digest", "n_chars", True), ("C3", "n_chars", "digest", False), ("C4", "lang", "source", False),
    ("C5", "digest", "source", False), ("C6", "doc_id", "digest", True), ("C7", "lang,source", "digest", False), ("C8", "lang", "author", False),
]


@query("V11_conflations", f"""WITH {_TEXTS_SQL}, v AS ({_lattice('t', _TEXT_ATTRIBUTES)})
SELECT id, holds = settles AS state, coalesce(tested, 0) AS tested, coalesce(broken, 0) AS broken, witness FROM (VALUES {', '.join(f"('{i}', '{x}', '{y}', {str(s).lower()})" for i, x, y, s in _CLAIMS)}) c(id, determinant, dependent, settles) LEFT JOIN v USING (determinant, dependent)""")
def conflations(spark, sf_dir):
    return dependencies.audited(dependencies.verdicts(_texts(spark, sf_dir), _TEXT_ATTRIBUTES), _CLAIMS)


_RATE = "CASE WHEN {d} > 0 THEN floor(({n})::DOUBLE / ({d})::DOUBLE * 1000000.0::DOUBLE + 0.5) / 1000000.0::DOUBLE END"


@query("A18_arms", f"""
WITH w AS (SELECT doc_id, lang, text, len(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9_]+'), lambda x: x <> '')) AS words FROM documents),
r AS (SELECT l.doc_id, toxic, d.doc_id IS NULL AS failed, CASE WHEN words < 50 THEN 'boundary' WHEN lang = 'en' THEN 'in_profile' ELSE 'paraphrase' END AS arm, CASE WHEN d.doc_id IS NULL THEN NULL WHEN regexp_matches(text, '[#$%&*|]') THEN 1 WHEN words >= 80 THEN 0 END AS predicted FROM (SELECT doc_id, max(toxic) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id) l LEFT JOIN w d USING (doc_id)),
p AS (SELECT arm, doc_id // 2 AS pair, count(*) AS n, count(*) FILTER (predicted = toxic) AS exact, min(toxic) <> max(toxic) AS reversed FROM r GROUP BY ALL),
a AS (SELECT arm, count(*) AS labelled, count(predicted) AS accepted, count(*) FILTER (predicted = toxic) AS exact, count(*) FILTER (failed) AS failures FROM r GROUP BY arm),
q AS (SELECT arm, count(*) FILTER (n = 2) AS pairs, count(*) FILTER (n = 2 AND exact = 2 AND reversed) AS reversals FROM p GROUP BY arm)
SELECT arm, labelled, accepted, labelled - accepted AS unknown, exact, {_RATE.format(n='exact', d='labelled')} AS accuracy, {_RATE.format(n='exact', d='accepted')} AS accuracy_accepted, {_RATE.format(n='labelled - accepted', d='labelled')} AS unknown_rate, accepted - exact AS false_acceptance, failures, pairs, reversals, {_RATE.format(n='reversals', d='pairs')} AS reversal_consistency FROM a JOIN q USING (arm)""")
def arms(spark, sf_dir):
    """labels by arm against a rule's predictions from documents, which abstains on middling lengths; mates are an even id and the next, reversed where their labels differ."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "text", F.size(tokens(F.col("text"))).alias("words"), F.lit(True).alias("there"))
    marks = table(spark, sf_dir, "labels").where("doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = marks.join(d, "doc_id", "left").withColumn("there", F.coalesce("there", F.lit(False)))
    arm = F.when(F.col("words") < 50, "boundary").when(F.col("lang") == "en", "in_profile").otherwise("paraphrase")
    predicted = F.when(F.col("there"), F.when(F.col("text").rlike("[#$%&*|]"), 1).when(F.col("words") >= 80, 0))
    rows = rows.select("doc_id", arm.alias("arm"), "toxic", predicted.alias("predicted"), (~F.col("there")).alias("failed"))
    return blind.scores(rows, "arm", "toxic", "predicted", "failed", F.floor(F.col("doc_id") / 2))


# fixed values: residue of markup that cleaned texts do not hold
_RESIDUE = r"\{\{|\}\}|\[\[|\]\]|<[A-Za-z/!]|&[a-z]+;"
_RULES = ["text-empty", "text-residue", "count-of-characters", "language-undeclared", "doc-twice", "turn-unnumbered", "turn-without-role", "turn-empty", "ordinal-twice", "ordinal-gap", "page-without-url", "page-without-title", "page-without-unit", "page-without-passages", "url-twice"]
_H1, _TITLE = "<h1>([^<]*)</h1>", "<title>([^<]*)</title>"


def _rule(rule: str, key: str, source: str, good: str) -> str:
    return f"SELECT '{rule}' AS rule, coalesce({key}::VARCHAR, '') AS key FROM {source} WHERE NOT coalesce({good}, false)"


_BROKEN = " UNION ALL ".join(_rule(*r) for r in [
    ("text-empty", "doc_id", "documents", "trim(text) <> ''"), ("text-residue", "doc_id", "documents", f"NOT regexp_matches(text, '{_RESIDUE}')"),
    ("count-of-characters", "doc_id", "documents", "n_chars = length(text)"), ("language-undeclared", "doc_id", "documents", f"lang IN ({', '.join(repr(x) for x in _LANGS)})"),
    ("doc-twice", "doc_id", "(SELECT doc_id, count(*) AS n FROM documents GROUP BY doc_id)", "n = 1"),
    ("turn-unnumbered", "conv_id", "conversations", "turn IS NOT NULL"), ("turn-without-role", "conv_id", "conversations", "role <> ''"), ("turn-empty", "conv_id", "conversations", "trim(text) <> ''"),
    ("ordinal-twice", "conv_id", "w", "n = 1"), ("ordinal-gap", "conv_id", "w", "hi - lo + 1 = parts"),
    ("page-without-url", "page_id", "pages", "url <> ''"), ("page-without-title", "page_id", "pages", f"regexp_extract(html, '{_TITLE}', 1) <> ''"),
    ("page-without-unit", "page_id", "pages", f"contains(regexp_extract(html, '{_TITLE}', 1), split_part(regexp_extract(html, '{_H1}', 1), ' ', 1))"), ("page-without-passages", "page_id", "pages", "contains(html, '<p>')"),
    ("url-twice", "url", "(SELECT url, count(*) AS n FROM pages GROUP BY url)", "n = 1"),
])


@query("V1_validated", f"""WITH w AS (SELECT conv_id, max(n) AS n, count(*) AS parts, min(turn) AS lo, max(turn) AS hi FROM (SELECT conv_id, turn, count(*) AS n FROM conversations WHERE turn IS NOT NULL GROUP BY ALL) GROUP BY conv_id),
b AS ({_BROKEN}), r AS (SELECT unnest([{', '.join(repr(r) for r in _RULES)}]) AS rule)
SELECT rule, count(key) AS violations, coalesce(array_to_string(list_slice(list(key ORDER BY key) FILTER (key IS NOT NULL), 1, 3), '|'), '') AS sample FROM r LEFT JOIN b USING (rule) GROUP BY rule""")
def validated(spark, sf_dir):
    """documents, conversations (works of numbered turns) and pages against the format: what is missing, empty, miscounted, misnumbered, twice there or not cleaned."""
    d, t, p = (table(spark, sf_dir, name) for name in ("documents", "conversations", "pages"))
    c = F.col
    parts = [
        validation.broken(d, c("doc_id"), {"text-empty": F.trim("text") != "", "text-residue": ~c("text").rlike(_RESIDUE), "count-of-characters": c("n_chars") == F.length("text"), "language-undeclared": c("lang").isin(_LANGS)}),
        validation.repeated(d, "doc_id", "doc-twice"),
        validation.broken(t, c("conv_id"), {"turn-unnumbered": c("turn").isNotNull(), "turn-without-role": c("role") != "", "turn-empty": F.trim("text") != ""}),
        validation.works(t, "conv_id", "turn"),
        validation.broken(p, c("page_id"), {
            "page-without-url": c("url") != "", "page-without-title": F.regexp_extract("html", _TITLE, 1) != "",
            "page-without-unit": F.contains(F.regexp_extract("html", _TITLE, 1), F.split_part(F.regexp_extract("html", _H1, 1), F.lit(" "), F.lit(1))), "page-without-passages": F.contains("html", F.lit("<p>")),
        }),
        validation.repeated(p, "url", "url-twice"),
    ]
    return validation.report(parts, _RULES)
