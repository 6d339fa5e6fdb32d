"""Scans, snapshots, page headers, audits of held-out records, receipts, and what callers declare."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import u16len
from ..operators import adapters, audits, relations
from ..sources.fixtures import values, values_sql
from .fixtures import _HOLD, _training
from .registry import query, table

_UNITS = "length({0}) + len(regexp_extract_all({0}, '[\U00010000-\U0010ffff]'))"


@query("S2_within_units", f"SELECT doc_id, CAST({_UNITS.format('text')} AS INT) AS units FROM documents WHERE {_UNITS.format('text')} <= 2048")
def within_units(spark, sf_dir):
    return audits.within_units(table(spark, sf_dir, "documents"), "text").select("doc_id", u16len(F.col("text")).alias("units"))


@query("S7_pinned_snapshots", """WITH s AS (SELECT page_id, sha256(html) AS digest, length(url) AS revision FROM pages),
p AS (SELECT page_id, sha256(CASE WHEN url LIKE '%utm_%' THEN url ELSE html END) AS sha256, CASE WHEN url LIKE 'http:%' THEN length(url) ELSE 0 END AS revision FROM pages UNION ALL SELECT -1, sha256(''), 0)
SELECT p.page_id, CASE WHEN s.page_id IS NULL THEN 'missing' WHEN p.sha256 <> s.digest THEN 'digest-mismatch' WHEN p.revision <> s.revision THEN 'revision-mismatch' ELSE 'pinned' END AS status FROM p LEFT JOIN s ON p.page_id = s.page_id""")
def pinned_snapshots(spark, sf_dir):
    """Pins with another digest, with another revision, and of a page that is not there."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html", F.length("url").alias("revision"))
    body = F.when(F.contains("url", F.lit("utm_")), F.col("url")).otherwise(F.col("html"))
    pins = pages.select("page_id", F.sha2(body, 256).alias("sha256"), F.when(F.startswith("url", F.lit("http:")), F.col("revision")).otherwise(0).alias("revision"))
    absent = spark.range(1).select(F.lit(-1).cast("long").alias("page_id"), F.sha2(F.lit(""), 256).alias("sha256"), F.lit(0).alias("revision"))
    return audits.pinned(pages, pins.union(absent), "page_id", "html", "revision")


_RAW = [("w1", "甲{{!|乙|丙}}丁"), ("w2", "{{!|乙}}"), ("w3", "甲{{註|乙}}"), ("w4", "[[甲]]"), ("w5", "甲<br>乙"), ("w6", "平文"), ("w7", None), ("w8", "{{:韓非子/初見秦}}\n{{: 韓非子/存韓 }}<!-- n -->"), ("w9", "{{:甲}}" + "文" * 200), ("w10", "{{: 甲|乙}}")]
_W = values_sql(["id", "raw"], _RAW)


@query("C24_rendered", rf"SELECT id, CASE WHEN NOT regexp_matches(t, '[{{}}]|\[\[|\]\]|</?\w') THEN t END AS text FROM (SELECT id, regexp_replace(raw, '\{{\{{!\|([^|{{}}]+)\|[^{{}}]*\}}\}}', '\1', 'g') AS t FROM {_W})")
def rendered(spark, sf_dir):
    return values(spark, "id string, raw string", _RAW).select("id", audits.rendered(F.col("raw")).alias("text"))


@query("C25_containers", rf"""SELECT id, array_to_string(n, ',') AS targets, len(n) > 0 AND length(trim(regexp_replace(regexp_replace(regexp_replace(raw, '\{{\{{(?s:.*?)\}}\}}', '', 'g'), '<!--(?s:.*?)-->', '', 'g'), '<[^>]+>', '', 'g'))) < 200 AS container
FROM (SELECT id, raw, list_transform(regexp_extract_all(raw, '\{{\{{\s*:\s*([^|}}\n]+?)\s*\}}\}}', 1), lambda x: trim(x)) AS n FROM {_W} WHERE raw IS NOT NULL)""")
def containers(spark, sf_dir):
    rows = values(spark, "id string, raw string", _RAW).where("raw is not null")
    return rows.select("id", F.array_join(audits.transclusions(F.col("raw")), ",").alias("targets"), audits.is_container(F.col("raw")).alias("container"))


_LINKS = [("l1", "詩經/谷風 (邶風)", "[[../下泉|下泉]]"), ("l2", "戰國策/卷一", "[[戰國策/卷二#頭|卷二]]"), ("l3", "論語", "[[../學而]]"), ("l4", "a/b/c（d）", "無"), ("l5", "詩經/", None), ("l6", "x/y", "[[ z ]] [[w]]")]


@query("R20_units_links", rf"""SELECT id, regexp_replace(string_split(page, '/')[-1], '\s*[（(][^）)]*[）)]\s*$', '') AS unit,
CASE WHEN n = '' THEN NULL WHEN starts_with(n, '../') THEN regexp_extract(page, '^(.*/)', 1) || substr(n, 4) ELSE n END AS target FROM (SELECT id, page, trim(regexp_extract(value, '\[\[([^\]|#]+)(?:#[^\]|]*)?(?:\|[^\]]*)?\]\]', 1)) AS n FROM {values_sql(['id', 'page', 'value'], _LINKS)})""")
def units_links(spark, sf_dir):
    return values(spark, "id string, page string, value string", _LINKS).select("id", audits.unit_of(F.col("page")).alias("unit"), audits.link_target(F.col("value"), F.col("page")).alias("target"))


HEADERS = [
    ("h1", "文{{header|title=[[甲|乙]]|Next=[[../下]]\n| author = {{w|孔子|x=y}} }}{{x}}"),
    ("h2", "{{註|a}}{{album header\n|next=a=b|NEXT= c |=d|e}}"),
    ("h3", "{{header|a=1"),
    ("h4", "{{Header}}"),
    ("h5", "無"),
    ("h6", None),
    ("h7", "{{SKQS header|a={{b|{{c|d}}|e}}|f=g}}"),
]


@query("R20_header_fields")
def header_fields(spark, sf_dir):
    """No SQL: balance of braces; tested against a loop."""
    rows = values(spark, "id string, text string", HEADERS)
    return rows.select("id", F.explode(audits.header_fields(F.col("text"))).alias("f")).select("id", "f.key", "f.value")


_HELD = [(i, t, [r[1], r[0], r[2]] if k % 3 == 1 else r) for k, (i, t, r) in enumerate(_HOLD)] + [("outside", "甲給乙", ["甲", "乙", "書"])]


@query("E9_held_out_audit", f"SELECT id, split_part(id, '-', 3) || CASE WHEN split_part(id, '-', 4) <> '' THEN '-' || split_part(id, '-', 4) ELSE '' END AS construction, right_way AS clean FROM {values_sql(['id', 'right_way'], [(i, k % 3 != 1) for k, (i, _, _) in enumerate(_HOLD)])}")
def held_out_audit(spark, sf_dir):
    """Every third record has agent and recipient exchanged; one is outside the grammar."""
    held = values(spark, "id string, text string, roles array<string>", _HELD)
    return audits.held_out_audit(held, relations.learned_state(_training(spark)))


@query("E10_pools", "SELECT lang, count(*) AS pool, greatest(count(*) - 32, 0) AS dropped, count(*) > 32 AS refused FROM documents GROUP BY lang")
def pools(spark, sf_dir):
    return audits.projected(table(spark, sf_dir, "documents"), "lang", "doc_id", 32)[0]


@query("E10_cut", "SELECT lang, doc_id, CAST(place AS INT) AS place FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS place FROM documents) WHERE place <= 32")
def cut(spark, sf_dir):
    return audits.projected(table(spark, sf_dir, "documents").select("lang", "doc_id"), "lang", "doc_id", 32)[1]


_RULED = [("en", "src1"), ("de", "src2"), ("xx", "src0")]


@query("E25_open_questions", f"SELECT lang, source, count(*) AS n FROM documents WHERE (lang, source) NOT IN ({', '.join(map(str, _RULED))}) GROUP BY ALL")
def open_questions(spark, sf_dir):
    candidates = table(spark, sf_dir, "documents").where("lang is not null and source is not null").groupBy("lang", "source").agg(F.count("*").alias("n"))
    return audits.open_questions(candidates, values(spark, "lang string, source string", _RULED), ["lang", "source"], "n")


@query("T2_reopened", """WITH j AS (SELECT event_id, user_id, event_type = 'error' AS fails, value FROM events),
since AS (SELECT user_id, max(first) AS since FROM (SELECT user_id, fails, min(event_id) AS first FROM j GROUP BY ALL) GROUP BY user_id HAVING count(*) > 1)
SELECT user_id, since, CASE count(DISTINCT fails) FILTER (value >= 100) WHEN 0 THEN 'Unknown' WHEN 1 THEN 'Answered' ELSE 'Contested' END AS state FROM since JOIN j USING (user_id) GROUP BY user_id, since""")
def reopened(spark, sf_dir):
    """Errors speak against a user; what has a value under 100 is withdrawn later."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", (F.col("event_type") == "error").alias("fails"), "value")
    return audits.reopened(e, e.where("value < 100"), "user_id", "fails", "event_id", "event_id")


_NEEDLES = [("en", "The", True), ("en", "{{header", False), ("de", "und", True), ("fr", "-{", False), ("es", "zzzzzz", True), ("none", "a", False)]


@query("V2_content", f"SELECT lang, needle, wanted, coalesce(bool_or(contains(text, needle)), false) AS found, coalesce(bool_or(contains(text, needle)), false) = wanted AS ok FROM {values_sql(['lang', 'needle', 'wanted'], _NEEDLES)} LEFT JOIN documents USING (lang) GROUP BY lang, needle, wanted")
def content(spark, sf_dir):
    return audits.content_audit(table(spark, sf_dir, "documents"), values(spark, "lang string, needle string, wanted boolean", _NEEDLES), "lang", "text")


@query("V5_cohort", """SELECT unnest(['unique ids', 'unique texts', 'fresh texts', 'declared count']) AS "check", unnest([ids = n, texts = n, known = 0, n = 64]) AS ok
FROM (SELECT count(*) AS n, count(DISTINCT item_id) AS ids, count(DISTINCT text) AS texts, (SELECT count(DISTINCT b.text) FROM benchmark b JOIN documents d ON b.text = d.text) AS known FROM benchmark)""")
def cohort(spark, sf_dir):
    return audits.cohort_checks(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), "item_id", "text", 64)


@query("V6_blob_ids", "SELECT doc_id, sha1(encode('blob ' || octet_length(encode(text))) || encode(chr(0)) || encode(text)) AS blob FROM documents")
def blob_ids(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", audits.blob_id(F.col("text")).alias("blob"))


@query("V7_sequences", "SELECT conv_id, min(turn) = 0 AND max(turn) = count(*) - 1 AND count(DISTINCT turn) = count(*) AS gapless, coalesce(bool_and(role IS NOT DISTINCT FROM CASE turn % 2 WHEN 0 THEN 'user' WHEN 1 THEN 'assistant' END), false) AS in_order FROM conversations GROUP BY conv_id")
def sequences(spark, sf_dir):
    return audits.sequence_checks(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", ["user", "assistant"])


_RECORDS = [("r1", ["甲", "乙", "書"]), ("r2", ["乙", "甲", "書"]), ("r3", ["甲", "乙", "書"]), ("r4", ["甲", None, "書"]), ("r5", None)]


@query("J9_record_pairs", f"""WITH r AS (SELECT * FROM {values_sql(['id', 'roles'], _RECORDS)}) SELECT x.id AS a, y.id AS b, CASE WHEN x.roles IS NULL OR y.roles IS NULL THEN 'Unknown' WHEN x.roles = y.roles THEN 'SameRelation'
WHEN x.roles[1] = y.roles[2] AND x.roles[2] = y.roles[1] AND x.roles[3] = y.roles[3] THEN 'RoleReversal' ELSE 'DifferentRelation' END AS relation FROM r x JOIN r y ON x.id <> y.id""")
def record_pairs(spark, sf_dir):
    return audits.record_pairs(values(spark, "id string, roles array<string>", _RECORDS), "id", "roles")


_EVENTS = adapters.Adapter("events.v1", {"kind": lambda: F.col("event_type"), "large": lambda: F.col("value") >= 100}, lambda: F.concat_ws("#", F.lit("e"), F.col("event_id")), lambda: F.col("user_id"))


@query("UD1_adapter", "SELECT 'events.v1' AS schema, concat_ws('#', 'e', event_id) AS key, user_id AS source, event_type AS kind, value >= 100 AS large FROM events")
def adapter(spark, sf_dir):
    return _EVENTS.records(table(spark, sf_dir, "events")).select("schema", "key", "source", "context.kind", "context.large")


#: Labels of documents are their sources here; the first grammar reads naming frames, the second anything with a capital.
_GRAMMARS = {
    "de": adapters.Grammar(lambda t: F.when(t.rlike("und"), "joined"), lambda t, label: label != "src0", probe="a und b", provenance="authored"),
    "en": adapters.Grammar(lambda t: F.when(t.rlike("^[A-Z]"), "opened"), lambda t, label: F.length(t) > 0, probe="The", provenance="authored"),
}


@query("UD2_callbacks", "SELECT doc_id, CASE WHEN lang = 'de' AND contains(text, 'und') THEN 'joined' WHEN lang = 'en' AND regexp_matches(text, '^[A-Z]') THEN 'opened' END AS construction, CASE lang WHEN 'de' THEN source <> 'src0' WHEN 'en' THEN length(text) > 0 END AS consistent FROM documents")
def callbacks(spark, sf_dir):
    return adapters.audited(table(spark, sf_dir, "documents"), _GRAMMARS, "lang", "text", "source").select("doc_id", "construction", "consistent")


@query("UD3_grammars", f"SELECT * FROM {values_sql(['name', 'probe', 'provenance', 'construction'], [('de', 'a und b', 'authored', 'joined'), ('en', 'The', 'authored', 'opened')])}")
def grammars(spark, sf_dir):
    """Each registered grammar reads its own probe."""
    rows = values(spark, "name string, probe string, provenance string, label string", [(k, g.probe, g.provenance, "src1") for k, g in _GRAMMARS.items()])
    return adapters.audited(rows, _GRAMMARS, "name", "probe", "label").select("name", "probe", "provenance", "construction")


_WORKS = {"en": adapters.Work(drop_titles=["src1"], drop_lines="^[A-M]"), "de": adapters.Work("prefix", exclude="[02]$"), "fr": adapters.Work("nextChain", drop_elements=["b"])}


@query("UD4_works", """SELECT doc_id, CASE lang WHEN 'en' THEN array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '^[A-M]')), chr(10)) ELSE text END AS text FROM documents
WHERE lang = 'en' AND coalesce(source <> 'src1', true) OR lang = 'de' AND coalesce(NOT regexp_matches(source, '[02]$'), true) OR lang = 'fr'""")
def works(spark, sf_dir):
    return adapters.configured(table(spark, sf_dir, "documents"), _WORKS, "lang", "source", "text").select("doc_id", "text")


@query("UD5_handlers", "SELECT event_id, CASE event_type WHEN 'error' THEN CAST(user_id AS VARCHAR) WHEN 'signup' THEN props END AS answer, event_type IN ('error', 'signup') AS known FROM events")
def handlers(spark, sf_dir):
    return adapters.answered(table(spark, sf_dir, "events"), {"error": lambda: F.col("user_id"), "signup": lambda: F.col("props")}, "event_type").select("event_id", "answer", "known")
