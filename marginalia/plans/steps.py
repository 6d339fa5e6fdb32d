"""Steps of the cleaner one by one, citations, labels and store filters: entries of their own, over fixtures and tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import u16len
from ..operators import analytics, citations, corpus, frames, relations, stores
from ..sources.fixtures import literal, values, values_sql
from .fixtures import _SENTENCES, _training
from .registry import query, table

_MARKUP = [
    ("m1", "一<!-- note -->二<!--\nmore-->三"),
    ("m2", "前<onlyinclude>中 [[甲|乙]] {{另|子|丑}}</onlyinclude>後"),
    ("m3", "{{專|黃帝}}者，{{註|少典{{專|之}}子}}姓{{ruby|公孫|x}}。{{header|title=a}}"),
    ("m4", "冀州<sub>無塊曰壤</sub>，厥<SUB class=\"x\"/>土"),
    ("m5", "甲{{*s}}注{{專|乙}}{{*e}}丙"),
    ("m6", "-{徴}-與-{-{丰}-}-及-{zh-hant:體;zh-hans:体}-"),
    ("m7", "&#20013;&amp;&nbsp;&#65;&lt;&#9999999;"),
    ("m8", "= 一 =\n== 二 ==\n===== 三 =====\n文 = 武"),
    ("m9", "__NOTOC__始__FORCETOC__終\r\n\r\n\r\n\r\n:* 句 \t\n"),
    ("m10", "<div id=\"一之一\">'''一之一'''</div>關<div class=\"v\" id=\"二\">雎</div>"),
    ("m11", "{{未閉|文"),
    ("m12", ""),
]
_M = values_sql(["id", "text"], _MARKUP)


def _markup(spark):
    return values(spark, "id string, text string", _MARKUP)


def _step(name: str, sql: str, step):
    """A query that applies a step to the markup fixture; sql is the same over the column text."""

    @query(name, f"SELECT id, {sql} AS text FROM {_M}")
    def plan(spark, sf_dir):
        return _markup(spark).select("id", step(F.col("text")).alias("text"))

    return plan


def _nested(inner: str, rounds: list[tuple[str, str]], times: int) -> str:
    for _ in range(times):
        for rx, to in rounds:
            inner = f"regexp_replace({inner}, '{rx}', '{to}', 'g')"
    return inner


_KEPT = "|".join(n.replace("+", r"\+").replace("？", "？") for n in corpus.CONTENT_TEMPLATES)
_step("C1_comments", "regexp_replace(text, '<!--(?s:.*?)-->', '', 'g')", corpus.strip_comments)
_step("C2_only_included", "CASE WHEN regexp_extract(text, '(?s)<onlyinclude>(.*?)</onlyinclude>', 1) <> '' THEN regexp_extract(text, '(?s)<onlyinclude>(.*?)</onlyinclude>', 1) ELSE text END", corpus.only_included)
_step("C3_anchors", r"""regexp_replace(regexp_replace(text, '<div[^>]*\bid="([^"]+)"[^>]*>\s*''{2,3}\s*[^<'']+''{2,3}\s*</div>', chr(10) || chr(1) || 'A:\1' || chr(1) || chr(10), 'g'), '<div[^>]*\bid="([^"]+)"[^>]*>', chr(10) || chr(1) || 'A:\1' || chr(1) || chr(10), 'g')""", lambda t: F.translate(corpus.lift_anchors(t), "\u0000", "\u0001"))
_step("C4_annotations", r"regexp_replace(text, '\{\{\s*\*s\s*\}\}(?s:.*?)\{\{\s*\*e\s*\}\}', '', 'g')", corpus.strip_annotations)
# no template name begins with another's, so what is left after the first replacement has none of these names
_step("C5_nested_templates", _nested("text", [(r"\{\{\s*(?:" + _KEPT + r")\s*\|([^{}|]*)(?:\|[^{}]*)?\}\}", r"\1"), (r"\{\{[^{}]*\}\}", "")], 4), corpus.strip_templates)
_step("C6_elements", "regexp_replace(regexp_replace(text, '(?is)<sub\\b[^>]*>.*?</sub>', '', 'g'), '(?i)<sub\\b[^>]*/>', '', 'g')", lambda t: corpus.drop_elements(t, ["sub"]))
_step("C9_conversions", _nested("text", [(r"-\{(?:[^{}]*[:|])?([^{}:|]*)\}-", r"\1")], 3), corpus.strip_conversions)
_step("C10_numeric_entities", "replace(replace(text, '&#20013;', '中'), '&#65;', 'A')", corpus.decode_numeric)
_step("C13_lines", r"regexp_replace(regexp_replace(array_to_string(list_transform(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)), lambda x: regexp_replace(regexp_replace(x, '^[:;*#]+', ''), '^[ \t]+|[ \t]+$', '', 'g')), chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), '^\n+|\n+$', '', 'g')", corpus.normalize_lines)
_step("C14_demoted_headings", r"array_to_string(list_transform(string_split(text, chr(10)), lambda x: CASE WHEN regexp_matches(x, '^=[^=].*[^=]=$') THEN trim(x[2:length(x) - 1]) WHEN regexp_matches(x, '^={5}[^=].*[^=]={5}$') THEN trim(x[6:length(x) - 5]) ELSE x END), chr(10))", corpus.demote_headings)
_step("C17_dropped_lines", r"array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '^=+ *[一三]')), chr(10))", lambda t: corpus.drop_lines(t, "^=+ *[一三]"))


@query("C17_dropped_sections", "SELECT doc_id, source FROM documents WHERE source IS NULL OR trim(source) NOT IN ('src1', 'src2')")
def dropped_sections(spark, sf_dir):
    return corpus.drop_sections(table(spark, sf_dir, "documents"), "source", ["src1", "src2"]).select("doc_id", "source")


_TITLES = [("t1", "[[勸學篇]]第一"), ("t2", "宥坐篇{{*|注}}  第二"), ("t3", "{{+|國風‧邶}}"), ("t4", "野有死-{麕}-"), ("t5", None), ("t6", "'''甲''' &amp; ''乙''")]
_INLINE = r"regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '\{\{\+\|([^{}|]*)\}\}', '\1', 'g'), '\{\{[^{}]*\}\}', '', 'g'), '\[\[([^\]]*)\]\]', '\1', 'g')"


@query("C18_inline", f"SELECT id, trim(regexp_replace(regexp_replace(replace(regexp_replace({_INLINE}, '-\\{{([^{{}}]*)\\}}-', '\\1', 'g'), '&amp;', '&'), '''{{2,3}}', '', 'g'), '\\s+', ' ', 'g')) AS text FROM {values_sql(['id', 'text'], _TITLES)}")
def inline(spark, sf_dir):
    return values(spark, "id string, text string", _TITLES).select("id", corpus.clean_inline(F.col("text")).alias("text"))


@query("C21_template_tally", r"SELECT id, CAST(len(regexp_extract_all(text, '\{\{\s*(?:" + _KEPT + r")\s*\|')) AS INT) AS content, CAST(len(regexp_extract_all(text, '\{\{\s*(?:green|deepPink|annotate|註|註釋)\s*\|')) AS INT) AS commentary, CAST(len(regexp_extract_all(text, '\{\{')) AS INT) AS all_templates FROM " + _M)
def template_tally(spark, sf_dir):
    rows = _markup(spark).select("id", corpus.template_counts(F.col("text")).alias("c"))
    return rows.select("id", "c.content", "c.commentary", F.col("c.all").alias("all_templates"))


_CITING = [("p1", "《詩》云：「關關雎鳩」又《書》曰欽哉。"), ("p2", "故 《 易 》 之言：『潛龍勿用，陽在下也』"), ("p3", "《詩》曰"), ("p4", "詩云：無。"), ("p5", None), ("p6", "《論語》稱「一」不足。《孝經》云身體髮膚！")]
_RX = citations.STRICT


@query("R18_quotations", f"""WITH c AS (SELECT id, unnest(list_transform(range(1, len(n) + 1), lambda i: [CAST(i - 1 AS VARCHAR), n[i], regexp_replace(text, concat('^(?s:.*?', repeat('{_RX}(?s:.*?)', CAST(i - 1 AS INT)), ')', '{_RX}'), '')])) AS x
FROM (SELECT id, text, regexp_extract_all(text, '{_RX}', 1) AS n FROM {values_sql(['id', 'text'], _CITING)})),
q AS (SELECT id, CAST(x[1] AS INT) AS place, x[2] AS name, CASE WHEN regexp_matches(x[3], '{citations.QUOTED}') THEN regexp_extract(x[3], '{citations.QUOTED}', 1) WHEN regexp_matches(x[3], '{citations.SENTENCE}') THEN regexp_extract(x[3], '{citations.SENTENCE}', 1) END AS quote FROM c)
SELECT id, place, name, quote, regexp_replace(quote, '[\\s，。；：、！？「」『』（）()《》〈〉·—…]', '', 'g') AS norm FROM q""")
def quotations(spark, sf_dir):
    return citations.citations(values(spark, "id string, text string", _CITING), "text", ["id"])


_BARES = [("b1", "詩云：無。"), ("b2", "《詩》云"), ("b3", "尚書曰可。"), ("b4", "。書 曰：止。禮云「"), ("b5", "")]


@query("R19_bare_markers", f"SELECT id, CAST(len(regexp_extract_all(replace(text, '云「', ''), '(?:^|[^》一-鿿])(?:詩|書|易|禮)\\s*(?:曰|云)')) AS BIGINT) AS bare, CAST(len(regexp_extract_all(text, '{_RX}')) AS BIGINT) AS strict FROM {values_sql(['id', 'text'], _BARES)}")
def bare_markers(spark, sf_dir):
    n = lambda rx: F.regexp_count("text", F.lit(rx)).cast("long")
    return values(spark, "id string, text string", _BARES).select("id", n(citations.BARE).alias("bare"), n(citations.STRICT).alias("strict"))


_LABELS = [("agent", v) for v in ("孔子", "乃命", "子路曰", "王以", "", None, "一二三四五六", "於是")] + [("recipient", v) for v in ("子貢", "於子貢", "問者", "使者", "有若", "之")] + [("theme", "何謂")]


@query("R10_admissible", f"""SELECT role, value, CASE WHEN coalesce(value, '') = '' THEN 'empty' WHEN length(value) > 5 THEN 'too long'
WHEN role = 'agent' THEN CASE WHEN len(list_filter({literal(citations.PREFIXES)}, lambda p: starts_with(value, p))) > 0 THEN 'agent begins with a particle or adverb' WHEN len(list_filter({literal(citations.SUFFIXES)}, lambda p: ends_with(value, p))) > 0 THEN 'agent ends with a particle or adverb' WHEN translate(value, '曰謂問告語於于乎', '') <> value THEN 'agent contains a reporting verb or preposition' END
WHEN role = 'recipient' THEN CASE WHEN value[1] IN ('於', '于', '乎') THEN 'recipient carries the preposition' WHEN translate(value, '曰謂問告語於于乎', '') <> value THEN 'recipient contains a reporting verb' WHEN ends_with(value, '者') THEN 'recipient ends in 者' WHEN starts_with(value, '有') THEN 'recipient begins with 有' END END AS reason FROM {values_sql(['role', 'value'], _LABELS)}""")
def admissible(spark, sf_dir):
    return values(spark, "role string, value string", _LABELS).select("role", "value", citations.inadmissible(F.col("role"), F.col("value")).alias("reason"))


_CASES = [(1, "wei-quote", "甲", "乙", "丙"), (2, "wei-quote", "甲", None, "丙"), (3, "yue-quote", "甲", None, "丙"), (4, "yue-quote", "甲", "乙", "丙"), (5, "naming", None, None, "丙"), (6, "other", "甲", "乙", "丙"), (7, None, "甲", "乙", "丙")]


@query("R11_label_roles", f"""SELECT id, coalesce(CASE construction WHEN 'wei-quote' THEN agent IS NOT NULL AND recipient IS NOT NULL AND theme IS NOT NULL WHEN 'yue-quote' THEN agent IS NOT NULL AND recipient IS NULL AND theme IS NOT NULL WHEN 'naming' THEN agent IS NULL AND recipient IS NULL AND theme IS NOT NULL END, false) AS valid FROM {values_sql(['id', 'construction', 'agent', 'recipient', 'theme'], _CASES)}""")
def label_roles(spark, sf_dir):
    roles = {name: has for name, _, has in frames.FRAMES}
    rows = values(spark, "id int, construction string, agent string, recipient string, theme string", _CASES)
    return rows.select("id", citations.valid_label(F.col("construction"), roles, agent=F.col("agent"), recipient=F.col("recipient"), theme=F.col("theme")).alias("valid"))


@query("F3_provenance", "SELECT doc_id, lang FROM documents WHERE lang IN ('en', 'de')")
def provenance(spark, sf_dir):
    return citations.of_provenance(table(spark, sf_dir, "documents"), ["en", "de"], "lang").select("doc_id", "lang")


_OBJECTS = [(1, '{"id":"a","text":"b"}'), (2, '{"text":"b","id":"a"}'), (3, '{"id":"a"}'), (4, '{"id":"a","text":"b","more":1}'), (5, "[1]"), (6, "{bad"), (7, None)]


@query("F2_exact_keys", f"SELECT id, coalesce(CASE WHEN json_valid(raw) AND json_type(raw) = 'OBJECT' THEN list_sort(json_keys(raw)) = ['id', 'text'] END, false) AS fits FROM {values_sql(['id', 'raw'], _OBJECTS)}")
def exact_keys(spark, sf_dir):
    return values(spark, "id int, raw string", _OBJECTS).select("id", citations.exact_keys(F.col("raw"), ["id", "text"]).alias("fits"))


@query("S12_bounded_requests", "SELECT doc_id, coalesce(octet_length(encode(text)) <= 2048, false) AS fits FROM documents")
def bounded_requests(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", citations.within_bytes(F.col("text"), 2048).alias("fits"))


@query("F4_active", "SELECT l_orderkey, l_linenumber FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey AND o.o_orderpriority = '1-URGENT' AND o.o_custkey > l.l_linenumber)")
def active(spark, sf_dir):
    """Lines as records, urgent orders as retractions of all lines of their order that are of a lower number than the customer's."""
    gone = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("target"), F.col("o_custkey").alias("seq"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("seq"))
    return stores.active(rows, gone, "id", "target", "seq").select("l_orderkey", "l_linenumber")


@query("T4_ordered_append", "WITH h AS (SELECT user_id, event_id, sha256(concat_ws('|', event_id, event_type)) AS hash FROM events) SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS position, lag(hash) OVER (PARTITION BY user_id ORDER BY event_id) AS previous FROM h")
def ordered_append(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return stores.chained(e, "user_id", "event_id", F.concat_ws("|", "event_id", "event_type").cast("binary")).select("user_id", "event_id", F.col("position").cast("long").alias("position"), "previous")


@query("E11_claim_hashes", """SELECT doc_id, sha256('{"expected":{"agent":"' || lang || '","recipient":null,"theme":"' || source || '"},"grammar":"g1","text":"t' || doc_id || '"}') AS content_hash, sha256('{"grammar":"g1","text":"t' || doc_id || '"}') AS text_hash FROM documents""")
def claim_hashes(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.concat(F.lit("t"), "doc_id").alias("t"))
    expected = F.struct(F.col("lang").alias("agent"), F.lit(None).cast("string").alias("recipient"), F.col("source").alias("theme"))
    return d.select("doc_id", stores.content_hash(F.lit("g1"), F.col("t"), expected).alias("content_hash"), stores.text_hash(F.lit("g1"), F.col("t")).alias("text_hash"))


_STRICT_RX = {"grant": "^「[^「」\\r\\n]{1,32}」授「[^「」\\r\\n]{1,32}」「[^「」\\r\\n]{1,32}」。$", "hand-over": "^「[^「」\\r\\n]{1,32}」把「[^「」\\r\\n]{1,32}」交给「[^「」\\r\\n]{1,32}」。$", "receive": "^「[^「」\\r\\n]{1,32}」获「[^「」\\r\\n]{1,32}」所授「[^「」\\r\\n]{1,32}」。$"}


@query("R2_strict", "SELECT id, CASE " + " ".join(f"WHEN regexp_matches(text, '{rx}') THEN '{k}'" for k, rx in _STRICT_RX.items()) + f" END AS construction FROM {values_sql(['id', 'text'], _SENTENCES)}")
def strict(spark, sf_dir):
    return relations.parsed(values(spark, "id string, text string", _SENTENCES), strict=True).select("id", "construction")


_ORDERS = "SELECT row_number() OVER (ORDER BY a, b) - 1 AS ord, [a, b, 3 - a - b] AS o FROM range(3) x(a), range(3) y(b) WHERE a <> b"


@query("R5_orders", f"WITH o AS ({_ORDERS}) SELECT c AS construction, CAST(ord AS INT) AS ord, array_to_string(o, ' ') AS roles_order FROM o, (SELECT unnest(['grant', 'hand-over', 'receive']) AS c)")
def orders(spark, sf_dir):
    return relations.candidates(spark).select("construction", "ord", F.array_join(F.col("roles_order").cast("array<string>"), " ").alias("roles_order"))


@query("R4_assignments", f"WITH o AS ({_ORDERS}) SELECT n_nationkey, CAST(ord AS INT) AS ord, array_to_string(list_transform(o, lambda k: [n_name, CAST(n_regionkey AS VARCHAR), CAST(n_nationkey AS VARCHAR)][k + 1]), '|') AS roles FROM nation, o")
def assignments(spark, sf_dir):
    slots = F.array("n_name", F.col("n_regionkey").cast("string"), F.col("n_nationkey").cast("string"))
    each = F.array(*[F.struct(F.lit(k).alias("ord"), F.array(*map(F.lit, o)).alias("o")) for k, o in enumerate(relations.ORDERS)])
    rows = table(spark, sf_dir, "nation").select("n_nationkey", slots.alias("s"), F.explode(each).alias("e"))
    return rows.select("n_nationkey", "e.ord", F.array_join(relations.assigned(F.col("s"), F.col("e.o")), "|").alias("roles"))


@query("E1_replayed_state", f"""WITH o AS ({_ORDERS}), t AS (SELECT * FROM {values_sql(['c', 'o'], [('grant', [0, 1, 2]), ('hand-over', [0, 2, 1]), ('receive', [1, 0, 2])])}) SELECT c AS construction, CAST(ord AS INT) AS ord FROM t JOIN o USING (o)""")
def replayed_state(spark, sf_dir):
    return relations.learned_state(_training(spark)).select("construction", "ord")


@query("E3_learner_fuel", "SELECT fuel, CAST(least(fuel, 18) AS BIGINT) AS checks, CAST(CASE WHEN fuel < 1 THEN 0 WHEN fuel < 8 THEN 1 WHEN fuel < 15 THEN 2 ELSE 3 END AS BIGINT) AS matches FROM (SELECT unnest([0, 1, 7, 8, 14, 15, 18, 40]) AS fuel)")
def learner_fuel(spark, sf_dir):
    """What the learner has checked and matched at several amounts of fuel, from the trace with enough of it."""
    trace = relations.learned(_training(spark), fuel=40)
    fuels = values(spark, "fuel int", [(f,) for f in (0, 1, 7, 8, 14, 15, 18, 40)])
    both = fuels.join(F.broadcast(trace), F.col("checked") <= F.col("fuel"), "left")  # 18 rows at most
    return both.groupBy("fuel").agg(F.count("checked").alias("checks"), F.count_if("matches").alias("matches"))


@query("J9_ordered_pairs", "SELECT a.n_nationkey AS a, b.n_nationkey AS b, CASE WHEN a.n_regionkey = b.n_regionkey THEN 'SameRelation' ELSE 'DifferentRelation' END AS answer FROM nation a, nation b WHERE a.n_nationkey <> b.n_nationkey")
def ordered_pairs(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    of = lambda s: n.select(F.col("n_nationkey").alias(s), F.array(F.col("n_regionkey").cast("string"), F.lit("x"), F.lit("y")).alias(f"r{s}"))
    # a declared store of 25 records, broadcast against itself
    return of("a").join(F.broadcast(of("b")), F.col("a") != F.col("b")).select("a", "b", relations.compared(F.col("ra"), F.col("rb")).alias("answer"))


@query("W6_stable_top", "SELECT c_custkey, c_nationkey, CAST(c_acctbal AS DOUBLE) AS balance FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 25")
def stable_top(spark, sf_dir):
    return analytics.top(table(spark, sf_dir, "customer"), 25, "c_acctbal", "c_custkey").select("c_custkey", "c_nationkey", F.col("c_acctbal").cast("double").alias("balance"))


_LADDER = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("W7_ladder", f"SELECT o_orderpriority AS rung, CAST(list_position({literal(_LADDER)}, o_orderpriority) AS INT) AS height, count(*) AS orders, list_position({literal(_LADDER)}, o_orderpriority) <= 2 AS high FROM orders GROUP BY ALL")
def ladder(spark, sf_dir):
    height = F.array_position(F.array(*map(F.lit, _LADDER)), F.col("o_orderpriority")).cast("int")
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("rung"), height.alias("height")).agg(F.count("*").alias("orders")).withColumn("high", F.col("height") <= 2)


@query("F5_readable", "SELECT source, count(*) FILTER (regexp_matches(text, '(?:名曰|一曰|亦曰)')) AS readable FROM documents GROUP BY source")
def readable(spark, sf_dir):
    found = frames.read_frames(table(spark, sf_dir, "documents").select("source", "text"), "text", [f for f in frames.FRAMES if f[0] == "naming"])
    return found.groupBy("source").agg(F.count_if(F.col("construction").isNotNull()).alias("readable"))


@query("F7_named_ends", "WITH e AS (SELECT l_partkey AS a, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS b FROM lineitem) SELECT a, b, count(*) AS n FROM e WHERE b IS NOT NULL AND a <> b AND length(CAST(a AS VARCHAR)) <= 2 AND length(CAST(b AS VARCHAR)) <= 2 GROUP BY ALL")
def named_ends(spark, sf_dir):
    e = analytics.transitions(table(spark, sf_dir, "lineitem"), "l_orderkey", ["l_linenumber", "l_partkey"], "l_partkey")
    short = lambda c: F.length(F.col(c).cast("string")).between(1, 2)
    return e.where(short("a") & short("b")).groupBy("a", "b").agg(F.count("*").alias("n"))


@query("J5_scored_by_index", "WITH p AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM labels) SELECT i % 2 AS arm, count(*) AS total, count(*) FILTER ((i % 2) = toxic) AS correct FROM p JOIN labels USING (doc_id) GROUP BY ALL")
def scored_by_index(spark, sf_dir):
    """Predictions stand in a list by place; a label's place is its rank by id, found without one global sort."""
    places = analytics.stride(table(spark, sf_dir, "labels"), "doc_id", 1)
    rows = places.withColumn("arm", F.col("place") % 2)
    return rows.groupBy("arm").agg(F.count("*").alias("total"), F.count_if(F.col("arm") == F.col("toxic")).alias("correct"))


@query("R9_utf16_offsets", "SELECT id, CAST(length(before) + len(regexp_extract_all(before, '[\U00010000-\U0010ffff]')) AS INT) AS start FROM (SELECT id, string_split(text, '曰')[1] AS before FROM (VALUES (1, '子曰'), (2, '😀子曰'), (3, '曰'), (4, '𠀀𠀁x曰')) t(id, text))")
def utf16_offsets(spark, sf_dir):
    rows = values(spark, "id int, text string", [(1, "子曰"), (2, "😀子曰"), (3, "曰"), (4, "𠀀𠀁x曰")])
    return rows.select("id", u16len(F.substring_index("text", "曰", 1)).alias("start"))
