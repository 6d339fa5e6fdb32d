"""Fixture form: literal sentences of the controlled profiles and of inscriptions, and the frame parser on documents."""

from __future__ import annotations

import uuid
from itertools import permutations

from pyspark.sql import functions as F

from ..operators import analytics, apertures, corpus, frames, inscription, relations
from ..sources.fixtures import values, values_sql
from ..sources.tables import shared_dir
from ..streaming import logs
from .registry import query, table

_SENTENCES = [
    ("s1", "「甲」授「乙」「书」。"),
    ("s2", "「甲」把「书」交给「乙」。"),
    ("s3", "「乙」获「甲」所授「书」。"),
    ("s4", "「甲」未授「乙」「书」。"),
    ("s5", "甲给乙一本书。"),
    ("s6", ""),
    ("s7", "「甲」授「乙」。"),
    ("s8", "「甲」授「乙」「书」"),
    ("s9", None),
]
_SLOT = "「([^「」\\r\\n]{1,32})」"
_RX = {"grant": f"^{_SLOT}授{_SLOT}{_SLOT}。?$", "hand-over": f"^{_SLOT}把{_SLOT}交给{_SLOT}。?$", "receive": f"^{_SLOT}获{_SLOT}所授{_SLOT}。?$"}


@query("R1_controlled", f"SELECT id, c AS construction, CASE c " + " ".join(f"WHEN '{k}' THEN concat_ws('|', regexp_extract(text, '{rx}', 1), regexp_extract(text, '{rx}', 2), regexp_extract(text, '{rx}', 3))" for k, rx in _RX.items()) + f" END AS slots FROM (SELECT id, text, CASE " + " ".join(f"WHEN regexp_matches(text, '{rx}') THEN '{k}'" for k, rx in _RX.items()) + f" END AS c FROM {values_sql(['id', 'text'], _SENTENCES)})")
def controlled(spark, sf_dir):
    rows = relations.parsed(values(spark, "id string, text string", _SENTENCES))
    return rows.select("id", "construction", F.when(F.col("slots").isNotNull(), F.array_join("slots", "|")).alias("slots"))


@query("R3_split_parser", f"SELECT id, CASE " + " ".join(f"WHEN regexp_matches(text, '{rx.replace('。?', '。')}') THEN '{k}'" for k, rx in _RX.items()) + f" END AS construction FROM {values_sql(['id', 'text'], _SENTENCES)}")
def split_parser(spark, sf_dir):
    return relations.parsed_by_split(values(spark, "id string, text string", _SENTENCES)).select("id", "construction")


_FORMS = {"grant": "「{a}」授「{r}」「{t}」。", "hand-over": "「{a}」把「{t}」交给「{r}」。", "receive": "「{r}」获「{a}」所授「{t}」。"}
_TRAIN = [(k, f"train-{k}", form.format(a="甲", r="乙", t="书"), ["甲", "乙", "书"]) for k, form in enumerate(_FORMS.values())]
_HOLD = [(f"hold-{i}-{c}", form.format(a=a, r=r, t=t), [a, r, t]) for i, (a, r, t) in enumerate(permutations(["丙", "丁", "帛"])) for c, form in _FORMS.items()]


def _training(spark):
    return values(spark, "seq int, id string, text string, roles array<string>", _TRAIN)


@query("E5_learner_trace", "SELECT CAST(seq AS INT) AS seq, CAST(ord AS INT) AS ord, CAST(seq * 6 + ord + 1 AS INT) AS checked, ord = CASE seq WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS matches FROM range(3) a(seq), range(6) b(ord) WHERE seq * 6 + ord < 15")
def learner_trace(spark, sf_dir):
    """Fuel 15 of the 18 checks that the three sentences take."""
    return relations.learned(_training(spark), fuel=15).select("seq", "ord", "checked", "matches")


@query("E2_read_held_out", f"SELECT id, 'KnownFiniteGrammar' AS status, NULL::VARCHAR AS reason, concat_ws('|', r1, r2, r3) AS roles FROM {values_sql(['id', 'r1', 'r2', 'r3'], [(i, *r) for i, _, r in _HOLD])}")
def read_held_out(spark, sf_dir):
    rows = values(spark, "id string, text string, expected array<string>", _HOLD)
    out = relations.read(rows.select("id", "text"), relations.learned_state(_training(spark)))
    return out.select("id", "status", "reason", F.array_join("roles", "|").alias("roles"))


@query("E6_without_evidence", f"SELECT id, 'Unknown' AS status, 'ambiguous-role-mapping' AS reason FROM {values_sql(['id'], [(i,) for i, _, _ in _HOLD])}")
def without_evidence(spark, sf_dir):
    """The control: with fuel 0 no order is refuted, so no sentence has one reading."""
    rows = values(spark, "id string, text string, expected array<string>", _HOLD)
    return relations.read(rows.select("id", "text"), relations.learned_state(_training(spark), fuel=0)).select("id", "status", "reason")


@query("A15_leave_one_out", "SELECT id, 'ambiguous-role-mapping' AS reason FROM (VALUES ('train-0'), ('train-1'), ('train-2')) t(id)")
def leave_one_out(spark, sf_dir):
    """Each construction has one example, so without it its mapping is not determined."""
    out = None
    for k in range(len(_TRAIN)):
        rows = _training(spark)
        one = relations.read(rows.where(F.col("seq") == k).select("id", "text"), relations.learned_state(rows.where(F.col("seq") != k))).select("id", "reason")
        out = one if out is None else out.union(one)
    return out


_PAIRS = [("p1", "甲|乙|书", "甲|乙|书"), ("p2", "甲|乙|书", "乙|甲|书"), ("p3", "甲|乙|书", "甲|丙|书"), ("p4", "甲|乙|书", None)]


@query("E4_compared", f"SELECT id, CASE WHEN b IS NULL THEN 'Unknown' WHEN a = b THEN 'SameRelation' WHEN split_part(a, '|', 1) = split_part(b, '|', 2) AND split_part(a, '|', 2) = split_part(b, '|', 1) AND split_part(a, '|', 3) = split_part(b, '|', 3) THEN 'RoleReversal' ELSE 'DifferentRelation' END AS relation FROM {values_sql(['id', 'a', 'b'], _PAIRS)}")
def compared(spark, sf_dir):
    rows = values(spark, "id string, a string, b string", _PAIRS)
    return rows.select("id", relations.compared(F.split("a", "\\|"), F.split("b", "\\|")).alias("relation"))


_PASSAGES = [
    ("f1", "孔子謂弟子曰：「學而時習之。」"),
    ("f2", "子曰：「學而時習之。」"),
    ("f3", "詩云：「緡蠻黃鳥。」子曰：「於止。」"),
    ("f4", "其器名曰鼎，其樂號曰韶。"),
    ("f5", "無對話之文。"),
    ("f6", "孟子告齊王曰：「君之視臣，名曰手足。」"),
]
_GOLD = [
    ("f1", "wei-quote", "孔子", "弟子", "學而時習之。", 0, 15, 0),
    ("f2", "yue-quote", "子", None, "學而時習之。", 0, 11, 0),
    ("f3", "yue-quote", "子", None, "於止。", 10, 18, 1),
    ("f4", "naming", None, None, "鼎", 2, 5, 1),
    ("f5", None, None, None, None, None, None, 0),
    ("f6", "gao-quote", "孟子", "齊王", "君之視臣，名曰手足。", 0, 19, 0),
]


@query("R8_frames", f"SELECT * FROM {values_sql(['id', 'construction', 'agent', 'recipient', 'theme', 'start', 'end_', 'additional'], _GOLD)}")
def frame_fold(spark, sf_dir):
    out = frames.read_frames(values(spark, "id string, text string", _PASSAGES))
    return out.select("id", "construction", "agent", "recipient", "theme", "start", F.col("end").alias("end_"), "additional")


_ASCII = [("assign", '([A-Za-z]+) = "([0-9A-Za-z]+)"', ["agent", "theme"]), ("quoted", '"([0-9A-Za-z]+)"', ["theme"])]


@query("R7_document_frames", """
SELECT doc_id, CASE WHEN n > 0 THEN 'assign' WHEN q > 0 THEN 'quoted' END AS construction, CASE WHEN n > 0 THEN regexp_extract(text, '([A-Za-z]+) = "([0-9A-Za-z]+)"', 1) END AS agent,
CASE WHEN n > 0 THEN regexp_extract(text, '([A-Za-z]+) = "([0-9A-Za-z]+)"', 2) WHEN q > 0 THEN regexp_extract(text, '"([0-9A-Za-z]+)"', 1) END AS theme, CAST(greatest(q, n) - (greatest(q, n) > 0)::INT AS INT) AS additional
FROM (SELECT doc_id, text, len(regexp_extract_all(text, '[A-Za-z]+ = "[0-9A-Za-z]+"')) AS n, len(regexp_extract_all(text, '"[0-9A-Za-z]+"')) AS q FROM documents)""")
def document_frames(spark, sf_dir):
    out = frames.read_frames(table(spark, sf_dir, "documents").select("doc_id", "text"), frames=_ASCII, max_units=1 << 30)
    return out.select("doc_id", "construction", "agent", "theme", "additional")


_INSCRIPTIONS = [
    ("i1", "隹三年五月丁巳，王在宗周，令「史颂省苏」休又成事，马四匹、吉金，用乍彝。颂其万年无疆。"),
    ("i2", "唯王元年正月甲子，王在周，令虎成事。"),
    ("i3", "贞：卜，三"),
    ("i4", "學而時習之"),
    ("i5", None),
]
_FIELDS = [
    ("i1", "三年", "五月", "丁巳", "宗周", "史颂省苏", "马四匹|吉金", "万年无疆", 1, "time|location|command|completion|rewards|artifact|blessing"),
    ("i2", "王元年", "正月", "甲子", "周", "虎", "", None, 0, "time|location|command|completion"),
    ("i3", None, None, None, None, None, "", None, 1, ""),
    ("i4", None, None, None, None, None, "", None, 0, ""),
    ("i5", None, None, None, None, None, "", None, 0, ""),
]


@query("R12_inscription", f"SELECT * FROM {values_sql(['id', 'year', 'month', 'day', 'location', 'command', 'rewards', 'blessing', 'threes', 'signals'], _FIELDS)}")
def inscription_fields(spark, sf_dir):
    out = inscription.analyzed(values(spark, "id string, text string", _INSCRIPTIONS))
    return out.select("id", "year", "month", "day", "location", "command", F.array_join("rewards", "|").alias("rewards"), "blessing", "threes", F.array_join("signals", "|").alias("signals"))


@query("E22_scores", """SELECT * FROM (VALUES ('i1', 1.0, 1.0, 1.0, 0.625, 0.925, 'strong'), ('i2', 1.0, 0.667, 0.0, 0.375, 0.269, 'exploratory'), ('i3', 0.0, 0.0, 0.333, 0.25, 0.539, 'exploratory'), ('i4', 0.0, 0.0, 0.0, 0.0, 0.0, 'exploratory'), ('i5', 0.0, 0.0, 0.0, 0.0, 0.0, 'exploratory')) t(id, observation, action, memory, tone, convergence, band)""")
def inscription_scores(spark, sf_dir):
    from ..functions.text import half_up

    out = inscription.scored(inscription.analyzed(values(spark, "id string, text string", _INSCRIPTIONS)))
    return out.select("id", *[half_up(F.col(c), 3).alias(c) for c in ("observation", "action", "memory", "tone", "convergence")], "band")


@query("W4_trajectory")
def trajectory(spark, sf_dir):
    """Three optimizer steps per inscription; checked in the tests against a loop."""
    out = inscription.trajectory(inscription.scored(inscription.analyzed(values(spark, "id string, text string", _INSCRIPTIONS))))
    return out.select("id", F.explode("trajectory").alias("t")).select("id", "t.*")


@query("A4_census", "SELECT 'exploratory' AS band, count(*) AS documents, 0.0::DOUBLE AS mean FROM documents")
def census(spark, sf_dir):
    """The census of bands over documents, none of which is an inscription."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id"), F.col("text"))
    out = inscription.scored(inscription.analyzed(d))
    return out.groupBy("band").agg(F.count("*").alias("documents"), F.round(F.avg("convergence"), 4).alias("mean"))


@query("E24_gate", f"SELECT id, id <> 'i1' AS blocked, CASE WHEN id = 'i1' THEN text END AS result FROM {values_sql(['id', 'text'], _INSCRIPTIONS)}")
def gate(spark, sf_dir):
    rows = values(spark, "id string, text string", _INSCRIPTIONS).withColumn("result", F.col("text"))
    return inscription.gated(rows, F.col("id") == "i1", ["result"]).select("id", "blocked", "result")


_WIKI = [
    ("w1", "采采芣{{另|苢|苡}}"),
    ("w2", "爲變-{-{徴}-}-之聲"),
    ("w3", "<!-- note -->== 上 ==\n[[論語|子]]曰<ref>x</ref>\n\n\n\n__NOTOC__:學而[[Category:經]]"),
    ("w4", "a<onlyinclude>b&amp;c</onlyinclude>d"),
    ("w5", "{{header|title={{x}}}}正文"),
    ("w6", "{{開"),
]
_CLEAN = [("w1", "采采芣苢"), ("w2", "爲變徴之聲"), ("w3", "== 上 ==\n子曰\n\n學而"), ("w4", "b&c"), ("w5", "正文"), ("w6", "{{開")]


@query("C5_clean_wikitext", f"SELECT * FROM {values_sql(['id', 'text'], _CLEAN)}")
def clean_wikitext(spark, sf_dir):
    return values(spark, "id string, text string", _WIKI).select("id", corpus.clean_wikitext(F.col("text")).alias("text"))


_BOOK = [("b", "序\n== 一 ==\n甲\n乙\n=== 二 ===\n丙")]


@query("C15_sections", "SELECT * FROM (VALUES ('b', 0, NULL, '序'), ('b', 1, '一', '甲' || chr(10) || '乙'), ('b', 2, '二', '丙')) t(id, section, title, body)")
def sections(spark, sf_dir):
    out = corpus.sections(values(spark, "id string, text string", _BOOK), "id", "text")
    return out.select("id", "section", "title", F.trim(F.translate("body", "\n", "\u0001")).alias("body")).withColumn("body", F.translate(F.regexp_replace("body", "^\u0001+|\u0001+$", ""), "\u0001", "\n"))


_EVIDENCE = [("e1", "grant", True, True), ("e2", "grant", False, True), ("e3", "grant", False, False), ("e4", "receive", False, True), ("e5", "grant", False, True)]


@query("E8_core", f"SELECT construction, id, CAST(rank AS INT) AS rank FROM (SELECT construction, id, row_number() OVER (PARTITION BY construction ORDER BY supervisor DESC, corpus DESC, id) AS rank FROM {values_sql(['id', 'construction', 'supervisor', 'corpus'], _EVIDENCE)}) WHERE rank <= 2")
def core(spark, sf_dir):
    rows = values(spark, "id string, construction string, supervisor boolean, corpus boolean", _EVIDENCE)
    return analytics.core(rows, "construction", [F.desc("supervisor"), F.desc("corpus"), F.col("id")], 2).select("construction", "id", "rank")


@query("T3_stream_append", "SELECT sha256(concat_ws('|', event_type, user_id)) AS content_hash, count(*) > 0 AS there FROM events GROUP BY 1")
def stream_append(spark, sf_dir):
    """The log replayed as a stream of files, appended once by content; the path is a pattern, so that it may be a file or a folder."""
    schema = table(spark, sf_dir, "events").schema
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    logs.append_once(logs.read_log(spark, f"{sf_dir}/event[s].parquet", schema), ["event_type", "user_id"], f"{base}/log", f"{base}/state", "ts", "60 days").awaitTermination()  # what is told again within twice the table's thirty days
    return spark.read.parquet(f"{base}/log").select("content_hash", F.lit(True).alias("there"))


@query("A26_apertures")
def apertures_of_documents(spark, sf_dir):
    """The frames of R7_document_frames over documents, by language: what is read, what lies over what, which spans the fold refuses, which agents are too long for a label."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return apertures.scan(d, "doc_id", "lang", "text", _ASCII, lambda agent: F.length(agent) <= 5)
