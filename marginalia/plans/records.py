"""Logs, inquiries, validators and reports."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import intertext, records, relations
from ..sources.fixtures import values, values_sql
from .registry import query, table


def _line(**kw) -> str:
    return json.dumps(kw, ensure_ascii=False)


_CLAIM = {"grammar": "g1", "text": "「甲」授「乙」「书」。", "expected": {"agent": "甲", "recipient": "乙", "theme": "书"}}
_HASH = hashlib.sha256(json.dumps(_CLAIM, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
_LINES = [
    (1, _line(schema="evidence.v1", id="a", contentHash=_HASH, **_CLAIM)),
    (2, _line(schema="evidence.v1", id="b", contentHash="0" * 64, **_CLAIM)),
    (3, "{not json"),
    (4, _line(schema="other.v1", id="c")),
    (5, _line(schema="retraction.v1", id="d", targetId="a", reason="wrong")),
]
_ISSUES = [(1, "a", "evidence", None), (2, "b", None, "hash-mismatch"), (3, None, None, "bad-json"), (4, "c", None, "wrong-schema"), (5, "d", "retraction", None)]


@query("S4_evidence_lines", f"SELECT * FROM {values_sql(['line', 'id', 'kind', 'issue'], _ISSUES)}")
def evidence_lines(spark, sf_dir):
    return records.evidence_lines(values(spark, "line int, raw string", _LINES), "evidence.v1", "retraction.v1").select("line", "id", "kind", "issue")


_REDIRECTS = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("x", "y")]
_NAMES = [("a",), ("c",), ("x",), ("q",)]


@query("S9_redirects", f"""WITH r AS (SELECT * FROM {values_sql(['f', 't'], _REDIRECTS)}), p AS (SELECT * FROM {values_sql(['name'], _NAMES)})
SELECT name, coalesce(r3.t, r2.t, r1.t, name) AS target FROM p LEFT JOIN r r1 ON r1.f = name LEFT JOIN r r2 ON r2.f = r1.t LEFT JOIN r r3 ON r3.f = r2.t""")
def redirects(spark, sf_dir):
    return records.resolved(values(spark, "name string", _NAMES), values(spark, "from string, to string", _REDIRECTS))


_VOLUMES = [("卷一", 1), ("卷十", 10), ("卷十二", 12), ("卷二十", 20), ("卷三十五", 35), ("序", None)]


@query("K5_volume_key", f"SELECT * FROM {values_sql(['name', 'key'], _VOLUMES)}")
def volume_key(spark, sf_dir):
    return values(spark, "name string", [(n,) for n, _ in _VOLUMES]).select("name", records.volume_key(F.col("name")).alias("key"))


_TERNARY = [("t1", "觀「少」之九贊。"), ("t2", "观「中」之一赞"), ("t3", "觀「無」之二贊。"), ("t4", "觀「中」。"), ("t5", "觀「中」之十贊。"), ("t6", None), ("t7", "觀「少」之四贊"), ("t8", "看「中」。")]
_HEADS = [("中", "0000"), ("少", "0011")]


@query("R14_ternary_inquiry", f"""WITH q AS (SELECT id, text, coalesce(regexp_matches(text, '{records.TERNARY}'), false) AS hit, regexp_extract(text, '{records.TERNARY}', 1) AS name, regexp_extract(text, '{records.TERNARY}', 2) AS n FROM {values_sql(['id', 'text'], _TERNARY)}),
j AS (SELECT q.*, h.digits, CASE WHEN n <> '' THEN strpos('一二三四五六七八九', n) END AS z FROM q LEFT JOIN {values_sql(['name', 'digits'], _HEADS).replace('AS t(', 'AS h(')} ON hit AND h.name = q.name)
SELECT id, CASE WHEN digits IS NULL THEN 'Unknown' ELSE 'IndexedText' END AS status, CASE WHEN NOT hit THEN 'outside-declared-query-grammar' WHEN digits IS NULL THEN 'unknown-head' END AS reason, digits, CAST(CASE WHEN digits IS NOT NULL THEN z END AS INT) AS zan,
CASE WHEN digits IS NOT NULL THEN digits || CAST((z - 1) // 3 AS VARCHAR) || CAST((z - 1) % 3 AS VARCHAR) END AS address FROM j""")
def ternary_inquiry(spark, sf_dir):
    return records.ternary_inquiry(values(spark, "id string, text string", _TERNARY), values(spark, "name string, digits string", _HEADS))


_CHANGES = [("h1", "觀「乾」之初爻。"), ("h2", "观「坤」"), ("h3", "觀「鼎」。"), ("h4", "乾之初爻")]
_CHANGES_OUT = [("h1", "IndexedText", None, "111111", 1, "011111", "姤"), ("h2", "IndexedText", None, "000000", None, None, None), ("h3", "Unknown", "hexagram-name-not-in-catalog", None, None, None, None), ("h4", "Unknown", "outside-changes-inquiry-grammar", None, None, None, None)]


@query("R13_hexagram_inquiry", f"SELECT * FROM {values_sql(['id', 'status', 'reason', 'bits', 'position', 'changed', 'target'], _CHANGES_OUT)}")
def hexagram_inquiry(spark, sf_dir):
    catalog = values(spark, "name string, bits string", [("乾", "111111"), ("坤", "000000"), ("姤", "011111")])
    return records.hexagram_inquiry(values(spark, "id string, text string", _CHANGES), catalog)


_SYLLOGISMS = [
    ("y1", "凡「人」皆「动物」。凡「学者」皆「人」。故凡「学者」皆「动物」。"), ("y2", "凡「鱼」皆非「人」。有「学者」為「人」。故有「学者」非「鱼」。"),
    ("y3", "凡「人」皆「动物」。凡「学者」皆「马」。故凡「学者」皆「动物」。"), ("y4", "人皆动物"), ("y5", "凡「人」皆「物」。有「人」为「士」。故有「士」为「物」"),
    ("y6", "凡「物」皆「人」。有「人」非「士」。故有「士」非「物」。"), ("y7", "有「人」皆「物」。凡「士」皆「人」。故凡「士」皆「物」。"), ("y8", "凡「甲」皆「乙」。凡「丙」皆「甲」。故凡「乙」皆「丙」。"),
    ("y9", "凡「人」皆「物」。" * 60), ("y10", None), ("y11", "凡「甲」皆「乙」。凡「甲」皆「乙」。故凡「甲」皆「乙」。"),
]
_PART = lambda k, g: f"regexp_extract(CASE WHEN {k} = 3 THEN substr(p[3], 2) ELSE p[{k}] END, '{records.CLAUSE}', {g})"
_KIND = lambda k: f"CASE WHEN {_PART(k, 1)} = '凡' AND {_PART(k, 3)} = '皆' THEN 'A' WHEN {_PART(k, 1)} = '凡' AND {_PART(k, 3)} = '皆非' THEN 'E' WHEN {_PART(k, 1)} = '有' AND {_PART(k, 3)} IN ('為', '为') THEN 'I' WHEN {_PART(k, 1)} = '有' AND {_PART(k, 3)} = '非' THEN 'O' END"


@query("R15_syllogism_text", f"""WITH a AS (SELECT id, text, string_split(text, '。') AS c FROM {values_sql(['id', 'text'], _SYLLOGISMS)}),
b AS (SELECT id, CASE WHEN length(text) <= 512 THEN CASE WHEN c[len(c)] = '' THEN c[1:len(c)-1] ELSE c END END AS p FROM a),
k AS (SELECT id, p, {', '.join(f"{_KIND(k)} AS k{k}, {_PART(k, 2)} AS s{k}, {_PART(k, 4)} AS o{k}" for k in (1, 2, 3))} FROM b),
m AS (SELECT *, list_distinct([s1, o1, s2, o2, s3, o3]) AS terms FROM k), n AS (SELECT *, list_filter(terms, lambda x: x <> s3 AND x <> o3)[1] AS mid FROM m),
f AS (SELECT *, CASE WHEN s1 = mid AND o1 = o3 AND s2 = s3 AND o2 = mid THEN 1 WHEN s1 = o3 AND o1 = mid AND s2 = s3 AND o2 = mid THEN 2 WHEN s1 = mid AND o1 = o3 AND s2 = mid AND o2 = s3 THEN 3 WHEN s1 = o3 AND o1 = mid AND s2 = mid AND o2 = s3 THEN 4 END AS fig FROM n),
r AS (SELECT *, CASE WHEN p IS NULL THEN 'outside-syllogism-grammar' WHEN len(p) <> 3 OR NOT coalesce(starts_with(p[3], '故'), false) THEN 'expected-two-premises-and-conclusion' WHEN k1 IS NULL OR k2 IS NULL OR k3 IS NULL THEN 'outside-syllogism-grammar'
WHEN len(terms) <> 3 OR s3 = o3 THEN 'requires-three-distinct-term-names' WHEN fig IS NULL THEN 'not-a-standard-figure-in-declared-premise-order' END AS reason FROM f)
SELECT id, CASE WHEN reason IS NULL THEN 'Parsed' ELSE 'Unknown' END AS status, reason, CASE WHEN reason IS NULL THEN k1 || k2 || k3 END AS mood, CASE WHEN reason IS NULL THEN fig END AS figure FROM r""")
def syllogism_text(spark, sf_dir):
    return records.syllogism_text(values(spark, "id string, text string", _SYLLOGISMS))


_CLAIMS = [("c1", "e1"), ("c1", "e2"), ("c2", "e9")]


@query("J12_warrants", "SELECT * FROM (VALUES ('c1', 'e1', 'present'), ('c1', 'e2', 'retracted'), ('c2', 'e9', 'missing')) t(claim, ref, state)")
def warrants(spark, sf_dir):
    return records.warranted(values(spark, "claim string, ref string", _CLAIMS), values(spark, "id string", [("e1",), ("e2",)]), values(spark, "target_id string", [("e2",)]))


_QUESTIONS = [("q1", "comparison", "甲|乙|书", "乙|甲|书"), ("q2", "comparison", "甲|乙|书", None), ("q3", "gloss", None, None), ("q4", "oracle", None, None)]


@query("E17_answers", "SELECT * FROM (VALUES ('q1', 'Answered', NULL, 'RoleReversal'), ('q2', 'Unknown', NULL, 'Unknown'), ('q3', 'Refused', 'glosses-are-not-licensed', NULL), ('q4', 'Refused', 'undeclared-question-type', NULL)) t(id, state, reason, answer)")
def answers(spark, sf_dir):
    rows = values(spark, "id string, type string, a string, b string", _QUESTIONS)
    return records.answered(rows, relations.compared(F.split("a", "\\|"), F.split("b", "\\|")))


_CONVENTIONS = [("analects", "詩", "odes"), ("mencius", "書", "documents")]
_MARKERS = [("analects", "詩"), ("analects", "書"), ("mencius", "書"), ("mencius", "禮")]


@query("J13_conventions", f"SELECT m.host, m.marker, means FROM {values_sql(['host', 'marker'], _MARKERS).replace('AS t(', 'AS m(')} LEFT JOIN {values_sql(['host', 'marker', 'means'], _CONVENTIONS).replace('AS t(', 'AS c(')} ON c.host = m.host AND c.marker = m.marker")
def conventions(spark, sf_dir):
    return values(spark, "host string, marker string", _MARKERS).join(F.broadcast(values(spark, "host string, marker string, means string", _CONVENTIONS)), ["host", "marker"], "left")


@query("V1_gates", """SELECT 'text' AS gate, count(*) FILTER (text IS NULL) AS violations, count(*) FILTER (text IS NULL) = 0 AS holds FROM documents
UNION ALL SELECT 'length', count(*) FILTER (length(text) <> n_chars), count(*) FILTER (length(text) <> n_chars) = 0 FROM documents
UNION ALL SELECT 'language', count(*) FILTER (lang NOT IN ('en', 'fr', 'de')), count(*) FILTER (lang NOT IN ('en', 'fr', 'de')) = 0 FROM documents""")
def corpus_gates(spark, sf_dir):
    return records.gates(table(spark, sf_dir, "documents"), {"text": F.col("text").isNotNull(), "length": F.length("text") == F.col("n_chars"), "language": F.col("lang").isin("en", "fr", "de")})


@query("X11_factorial", """SELECT a || r || t AS roles, c AS construction, e AS edit FROM (SELECT unnest(['丙', '丁', '帛']) AS a), (SELECT unnest(['丙', '丁', '帛']) AS r), (SELECT unnest(['丙', '丁', '帛']) AS t), (SELECT unnest(['grant', 'hand-over', 'receive']) AS c), (SELECT unnest(['none', 'no-stop', 'negated']) AS e) WHERE a <> r AND r <> t AND a <> t""")
def factorial(spark, sf_dir):
    names = relations.ORDERS
    roles = values(spark, "roles string", [("".join(["丙", "丁", "帛"][k] for k in o),) for o in names])
    forms = F.broadcast(values(spark, "construction string", [(c,) for c, _ in relations.CONSTRUCTIONS]))
    return roles.crossJoin(forms).crossJoin(F.broadcast(values(spark, "edit string", [("none",), ("no-stop",), ("negated",)])))  # three declared dimensions


@query("E20_seeds", """WITH k AS (SELECT lang, source, doc_id, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS k FROM documents WHERE length(text) > 200)
SELECT lang, source, doc_id, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY k, doc_id) AS rank FROM k) WHERE rank <= 25""")
def seeds(spark, sf_dir):
    return records.seeded(table(spark, sf_dir, "documents").where("length(text) > 200").select("lang", "source", "doc_id"), "lang", "source", "doc_id", 25)


@query("A17_crosstab", "SELECT lang, count(*) FILTER (quality = 1) AS good, count(*) FILTER (quality = 0) AS poor, count(*) FILTER (quality IS NULL) AS unlabelled FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang")
def crosstab(spark, sf_dir):
    state = F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor").otherwise("unlabelled")
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").select("lang", state.alias("state"))
    return rows.groupBy("lang").pivot("state", ["good", "poor", "unlabelled"]).agg(F.count(F.lit(1))).na.fill(0)


@query("A16_reasons", """WITH r AS (SELECT lang, CASE WHEN length(text) < 500 THEN 'too-short' WHEN regexp_matches(text, '[A-Za-z]+ = "') THEN 'readable' WHEN length(text) > 8000 THEN 'too-long' ELSE 'outside-grammar' END AS reason FROM documents),
c AS (SELECT lang, reason, count(*) AS n FROM r GROUP BY ALL) SELECT lang, reason, n, CAST(k AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, reason) AS k FROM c) WHERE k <= 3""")
def reasons(spark, sf_dir):
    from ..operators.analytics import core

    reason = F.when(F.length("text") < 500, "too-short").when(F.col("text").rlike('[A-Za-z]+ = "'), "readable").when(F.length("text") > 8000, "too-long").otherwise("outside-grammar")
    counts = table(spark, sf_dir, "documents").groupBy("lang", reason.alias("reason")).agg(F.count("*").alias("n"))
    return core(counts, "lang", [F.desc("n"), F.col("reason")], 3)


@query("A27_navigation", """WITH b AS (SELECT item_id, array_to_string(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9_]+'), lambda w: w <> ''), ' ') AS q FROM benchmark), d AS (SELECT doc_id, source, array_to_string(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9_]+'), lambda w: w <> ''), ' ') AS p FROM documents)
SELECT source, count(*) AS links, array_to_string(list_slice(list(item_id || ':' || doc_id ORDER BY item_id || ':' || doc_id), 1, 3), ' ') AS examples FROM b, d WHERE q <> '' AND contains(' ' || p || ' ', ' ' || q || ' ') GROUP BY source""")
def navigation(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select("item_id", intertext.normalized(F.col("text")).alias("q")).where("q <> ''")
    d = table(spark, sf_dir, "documents").select("doc_id", "source", intertext.normalized(F.col("text")).alias("p"))
    hits = intertext.contained(b, "q", d, "p", "doc_id").select("source", F.concat_ws(":", "item_id", "doc_id").alias("link")).distinct()
    # the least three per source, so no list of all links is gathered
    w = F.row_number().over(Window.partitionBy("source").orderBy("link"))
    first = hits.withColumn("k", w).where("k <= 3").groupBy("source").agg(F.array_join(F.array_sort(F.collect_list("link")), " ").alias("examples"))
    return hits.groupBy("source").agg(F.count("*").alias("links")).join(first, "source")


@query("A26_repeated_turns", "SELECT sha256(lower(text)) AS digest, count(*) AS n, count(DISTINCT conv_id) AS conversations FROM conversations GROUP BY 1 HAVING count(*) > 1")
def repeated_turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy(F.sha2(F.lower("text"), 256).alias("digest")).agg(F.count("*").alias("n"), F.count_distinct("conv_id").alias("conversations")).where("n > 1")
