"""Table form over documents, pages, benchmark and labels: the operators with parameters that suit these tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import share, tokens
from ..operators import analytics, corpus, intertext, stores, variants
from ..sources.fixtures import values, values_sql
from .registry import query, table

_TOKENS = "list_filter(regexp_split_to_array(lower({t}), '[^a-z0-9_]+'), lambda w: w <> '')"
_HALF = "floor(({x}) * {s}.0::DOUBLE + 0.5) / {s}.0::DOUBLE"


def _share(a: str, b: str, digits: int = 6) -> str:
    return _HALF.format(x=f"CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0)", s=10**digits)


@query("C16_passages", r"""
SELECT doc_id, CAST(i - 1 AS INT) AS passage, length(parts[i]) AS chars, md5(parts[i]) AS digest FROM (
SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS parts FROM documents), LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS i)""")
def passages(spark, sf_dir):
    p = corpus.split_passages(table(spark, sf_dir, "documents"), "doc_id", "text", "\n")
    return p.select("doc_id", "passage", F.length("text").alias("chars"), F.md5(F.col("text").cast("binary")).alias("digest"))


@query("C7_clean_html", r"""
WITH a AS (SELECT page_id, regexp_replace(html, '(?s)<!--.*?-->', '', 'g') AS t FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(t, '(?is)<ref[^>]*/>', '', 'g'), '(?is)<(ref|script|style)\b[^>]*>.*?</(ref|script|style)>', '', 'g') AS t FROM a),
c AS (SELECT page_id, regexp_replace(regexp_replace(t, '(?i)<br */?>|</p>|</div>|</li>|</h[1-6]>', chr(10), 'g'), '<[^>]*>', '', 'g') AS t FROM b),
d AS (SELECT page_id, replace(replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&amp;', '&') AS t FROM c),
e AS (SELECT page_id, array_to_string(list_transform(string_split(regexp_replace(t, '\r\n?', chr(10), 'g'), chr(10)), lambda x: regexp_replace(regexp_replace(x, '^[:;*#]+', ''), '^[ \t]+|[ \t]+$', '', 'g')), chr(10)) AS t FROM d)
SELECT page_id, length(t) AS chars, md5(t) AS digest FROM (SELECT page_id, regexp_replace(regexp_replace(t, '\n{3,}', chr(10) || chr(10), 'g'), '^\n+|\n+$', '', 'g') AS t FROM e)""")
def clean_html(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", corpus.clean_html(F.col("html")).alias("t"))
    return pages.select("page_id", F.length("t").alias("chars"), F.md5(F.col("t").cast("binary")).alias("digest"))


@query("C8_links", r"""
SELECT label, count(*) AS n, count(DISTINCT page_id) AS pages FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a [^>]*href="[^"]*"[^>]*>([^<]*)</a>', 1)) AS label FROM pages) GROUP BY label""")
def links(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", F.explode(F.expr("""regexp_extract_all(html, '<a [^>]*href="[^"]*"[^>]*>([^<]*)</a>', 1)""")).alias("label"))
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.count_distinct("page_id").alias("pages"))


@query("C12_drop_lines", r"""
SELECT doc_id, len(l) AS lines, len(list_filter(l, lambda x: NOT regexp_matches(x, '(?i)^(licensed under|all rights reserved|copyright)'))) AS kept FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)""")
def drop_lines(spark, sf_dir):
    rx = "(?i)^(licensed under|all rights reserved|copyright)"
    t = F.col("text")
    kept = F.size(F.filter(F.split(t, "\n"), lambda x: ~x.rlike(rx)))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(F.split(t, "\n")).alias("lines"), kept.alias("kept"))


_MARKED = [("w1", 1, "三一。凡治"), ("w1", 2, "因情"), ("w1", 3, "参观一"), ("w1", 4, "右經"), ("w1", 5, "生之，"), ("w2", 1, "因情"), ("w2", 2, "右三者天下之所當先務也"), ("w2", 3, "必罰二十"), ("w2", 4, "二。賞罰"), ("w2", 5, ""), ("w2", 6, "主道"), ("w2", 7, None)]


@query("C19_structural", f"""
WITH m AS (SELECT work, ord, text, lag(text) OVER (PARTITION BY work ORDER BY ord) AS before FROM {values_sql(['work', 'ord', 'text'], _MARKED)})
SELECT work, ord, CASE WHEN regexp_matches(text, '^右[^\n]{{0,8}}$') THEN 'right-colophon' WHEN length(text) <= 4 AND regexp_matches(text, '^[^\n]{{1,4}}[一二三四五六七八九十]$') THEN 'numbered-heading'
WHEN regexp_matches(before, '^[一二三四五六七八九十]+。') AND regexp_matches(text, '^[^\n]{{2,4}}$') THEN 'heading-after-numbered' END AS marker FROM m""")
def structural(spark, sf_dir):
    rows = values(spark, "work string, ord int, text string", _MARKED)
    return corpus.structural(rows, "text", "work", ["ord"]).select("work", "ord", "marker")


def _residue_sql(column: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({column}, '{rx}') THEN '{k}'" for k, rx in corpus.RESIDUE.items()) + " END"


@query("F6_residue", f"SELECT 'pages' AS place, {_residue_sql('html')} AS rule, count(*) AS n FROM pages GROUP BY ALL UNION ALL SELECT 'documents', {_residue_sql('text')}, count(*) FROM documents GROUP BY ALL")
def residue(spark, sf_dir):
    of = lambda name, column: table(spark, sf_dir, name).groupBy(F.lit(name).alias("place"), corpus.residue(F.col(column), corpus.RESIDUE).alias("rule")).agg(F.count("*").alias("n"))
    return of("pages", "html").union(of("documents", "text"))


@query("C23_normalized", f"SELECT doc_id, md5(array_to_string({_TOKENS.format(t='text')}, ' ')) AS digest, len({_TOKENS.format(t='text')}) AS words FROM documents")
def normalized(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(intertext.normalized(t).cast("binary")).alias("digest"), F.size(tokens(t)).alias("words"))


_HIT = """regexp_matches(text, '[A-Za-z_]+ [=:] "')"""


@query("A1_density", f"SELECT source, count(*) AS passages, count(*) FILTER ({_HIT}) AS readable, {_share('count(*) FILTER (' + _HIT + ')', 'count(*)', 4)} AS density FROM documents GROUP BY source")
def density(spark, sf_dir):
    return analytics.density(table(spark, sf_dir, "documents"), "source", F.col("text").rlike('[A-Za-z_]+ [=:] "'))


@query("A2_group_stats", f"""
WITH w AS (SELECT lang, source, count(*) AS passages, count(*) FILTER ({_HIT}) AS readable, {_share('count(*) FILTER (' + _HIT + ')', 'count(*)', 4)} AS density FROM documents GROUP BY lang, source)
SELECT lang, count(*) AS works, sum(passages)::BIGINT AS passages, sum(readable)::BIGINT AS readable, {_share('sum(readable)', 'sum(passages)')} AS pooled, {_HALF.format(x='quantile_cont(density, 0.5)', s=10000)} AS median, min(density) AS least, max(density) AS greatest FROM w GROUP BY lang""")
def group_stats(spark, sf_dir):
    hit = F.col("text").rlike('[A-Za-z_]+ [=:] "')
    per = table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("passages"), F.count_if(hit).alias("readable")).withColumn("density", share(F.col("readable"), F.col("passages"), 4))
    return analytics.group_stats(per, "lang")


@query("A3_hypothesis", f"""
WITH w AS (SELECT lang = 'en' AS en, source, count(*) AS passages, count(*) FILTER ({_HIT}) AS readable FROM documents GROUP BY ALL),
g AS (SELECT {_share('sum(readable) FILTER (en)', 'sum(passages) FILTER (en)')} AS p_en, {_share('sum(readable) FILTER (NOT en)', 'sum(passages) FILTER (NOT en)')} AS p_other FROM w)
SELECT p_en, p_other, {_HALF.format(x='p_en - p_other', s=1000000)} AS delta, CASE WHEN p_en > p_other THEN 'supported' ELSE 'not-supported' END AS verdict FROM g""")
def hypothesis(spark, sf_dir):
    from ..functions.text import half_up

    d = table(spark, sf_dir, "documents").select((F.col("lang") == "en").alias("en"), F.col("text").rlike('[A-Za-z_]+ [=:] "').alias("hit"))
    one = d.agg(share(F.count_if(F.col("en") & F.col("hit")), F.count_if("en")).alias("p_en"), share(F.count_if(~F.col("en") & F.col("hit")), F.count_if(~F.col("en"))).alias("p_other"))
    return one.select("p_en", "p_other", half_up(F.col("p_en") - F.col("p_other"), 6).alias("delta"), F.when(F.col("p_en") > F.col("p_other"), "supported").otherwise("not-supported").alias("verdict"))


_GRAMS = "list_transform(range(1, len(w) - {m} + 1), lambda i: array_to_string(w[i:i+{m}], ' '))"


@query("A8_grams", f"""
WITH t AS (SELECT doc_id, source, {_TOKENS.format(t='text')} AS w FROM documents),
g AS (SELECT doc_id, source, unnest(list_distinct(list_concat({_GRAMS.format(m=1)}, {_GRAMS.format(m=2)}))) AS gram FROM t)
SELECT gram, count(*) AS passages, count(DISTINCT source) AS groups, min(doc_id) AS witness FROM g GROUP BY gram HAVING count(*) >= 8 ORDER BY passages DESC, gram LIMIT 200""")
def gram_counts(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return analytics.top_grams(d, "doc_id", tokens(F.col("text")), [2, 3], "source", 8, 200)


_PATTERNS = {"token": 'token = "', "license": "(?i)licensed under", "mail": "[a-z0-9.]+@[a-z0-9.]+", "shout": "[A-Z]{6,}"}


@query("A11_pattern_coverage", " UNION ALL ".join(f"SELECT '{k}' AS pattern, count(*) FILTER (regexp_matches(text, '{rx}')) AS passages, sum(len(regexp_extract_all(text, '{rx}')))::BIGINT AS occurrences FROM documents" for k, rx in _PATTERNS.items()) + " UNION ALL SELECT 'any', count(*) FILTER (" + " OR ".join(f"regexp_matches(text, '{rx}')" for rx in _PATTERNS.values()) + "), NULL FROM documents")
def pattern_coverage(spark, sf_dir):
    return analytics.pattern_coverage(table(spark, sf_dir, "documents"), "text", _PATTERNS)


_NORM = "array_to_string(list_filter(regexp_split_to_array(lower({t}), '[^a-z0-9_]+'), lambda w: w <> ''), ' ')"
_CONTAINED = f"""b AS (SELECT item_id, {_NORM.format(t='text')} AS q FROM benchmark), d AS (SELECT doc_id, lang, {_NORM.format(t='text')} AS p FROM documents),
hits AS (SELECT item_id, doc_id, lang FROM b, d WHERE q <> '' AND contains(' ' || p || ' ', ' ' || q || ' '))"""


def _hits(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select("item_id", intertext.normalized(F.col("text")).alias("q")).where("q <> ''")
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", intertext.normalized(F.col("text")).alias("p"))
    return b, intertext.contained(b, "q", d, "p", "doc_id").select("item_id", "doc_id", "lang").distinct()


@query("J3_contained", f"WITH {_CONTAINED} SELECT item_id, count(*) AS documents, min(doc_id) AS first_doc FROM hits GROUP BY item_id")
def contained(spark, sf_dir):
    return _hits(spark, sf_dir)[1].groupBy("item_id").agg(F.count("*").alias("documents"), F.min("doc_id").alias("first_doc"))


@query("E21_citation_status", f"""WITH {_CONTAINED} SELECT item_id, CASE WHEN q IS NULL OR length(q) = 0 THEN 'none' WHEN length(q) < 60 THEN 'too-short' WHEN item_id IN (SELECT item_id FROM hits) THEN 'found-in-cited-work' ELSE 'not-found-in-cited-work' END AS status FROM b""")
def citation_status(spark, sf_dir):
    b, hits = _hits(spark, sf_dir)
    found = hits.select("item_id").distinct().withColumn("f", F.lit(True))
    status = intertext.citation_status(F.coalesce("f", F.lit(False)), F.lit(True), F.length("q"), 60)
    return b.join(found, "item_id", "left").select("item_id", status.alias("status"))


@query("A12_citation_matrix", f"WITH {_CONTAINED} SELECT lang, count(*) AS links, count(DISTINCT item_id) AS items, count(DISTINCT doc_id) AS documents FROM hits GROUP BY lang")
def citation_matrix(spark, sf_dir):
    return _hits(spark, sf_dir)[1].groupBy("lang").agg(F.count("*").alias("links"), F.count_distinct("item_id").alias("items"), F.count_distinct("doc_id").alias("documents"))


def _contexts(n: int) -> str:
    runs = ", ".join(f"lead(x1, {k - 1}) OVER v AS x{k}" for k in range(2, n + 1))
    places = " UNION ALL ".join(f"SELECT src, id, {at} AS at_, concat_ws(' ', {', '.join("'*'" if j == at else f'x{j}' for j in range(1, n + 1))}) AS context, x{at} AS word FROM l WHERE x{n} IS NOT NULL" for at in range(1, n + 1))
    return f"""t AS (SELECT 'b' AS src, item_id AS id, {_TOKENS.format(t='text')} AS w FROM benchmark UNION ALL SELECT 'd', doc_id, {_TOKENS.format(t='text')} FROM documents),
u AS (SELECT src, id, unnest(w) AS x1, unnest(range(1, len(w) + 1)) AS i FROM t), l AS (SELECT src, id, x1, {runs} FROM u WINDOW v AS (PARTITION BY src, id ORDER BY i)), k AS ({places})"""


@query("J4_near_matches", f"""WITH {_contexts(8)}, g AS (SELECT at_, context, word, count(*) AS n FROM k GROUP BY ALL) SELECT at_ AS "at", context, word, n FROM g SEMI JOIN (SELECT at_, context FROM g GROUP BY ALL HAVING count(*) > 1) USING (at_, context)""")
def near_matches(spark, sf_dir):
    """Windows of eight words that differ in one word: the words of each context that has several, and how often."""
    rows = table(spark, sf_dir, "benchmark").select("text").union(table(spark, sf_dir, "documents").select("text"))
    return variants.classes(rows, tokens(F.col("text")))


@query("A13_variants", f"""WITH {_contexts(5)}, q AS (SELECT DISTINCT id, at_, context, word FROM k WHERE src = 'b'), p AS (SELECT at_, context, word, min(id) AS passage FROM k WHERE src = 'd' GROUP BY ALL),
x AS (SELECT q.word AS f, p.word AS t, q.id, min(passage) AS passage FROM q JOIN p USING (at_, context) WHERE q.word <> p.word GROUP BY ALL)
SELECT f AS "from", t AS "to", count(*) AS quotes, array_to_string(list_slice(list(id || ':' || passage ORDER BY id), 1, 3), '|') AS witnesses FROM x GROUP BY ALL""")
def substitutions(spark, sf_dir):
    """What documents have for a word of a benchmark item in the same context: by items that show it, with three of them."""
    w = tokens(F.col("text"))
    return variants.substitutions(table(spark, sf_dir, "benchmark"), "item_id", w, table(spark, sf_dir, "documents"), "doc_id", w, 5)


@query("J2_text_lookup", """
WITH f AS (SELECT text, min(doc_id) AS first_doc, count(*) AS n FROM documents GROUP BY text)
SELECT doc_id, first_doc, n, CASE WHEN doc_id = first_doc THEN 'in-place' ELSE 'moved' END AS status FROM documents JOIN f USING (text) WHERE n > 1""")
def text_lookup(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    first = d.groupBy("h").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n")).where("n > 1")
    return d.join(first, "h").select("doc_id", "first_doc", "n", F.when(F.col("doc_id") == F.col("first_doc"), "in-place").otherwise("moved").alias("status"))


@query("E16_reconciled", """
WITH j AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'holds' ELSE 'fails' END AS v FROM labels UNION ALL SELECT doc_id, CASE WHEN toxic = 0 THEN 'holds' ELSE 'fails' END FROM labels),
c AS (SELECT doc_id, count(*) FILTER (v = 'holds') AS holds, count(*) FILTER (v = 'fails') AS fails FROM j GROUP BY doc_id)
SELECT doc_id, coalesce(holds, 0) AS holds, coalesce(fails, 0) AS fails, CASE WHEN holds > 0 AND fails > 0 THEN 'Contested' WHEN holds + fails > 0 THEN 'Answered' ELSE 'Unknown' END AS state,
CASE WHEN holds > 0 AND fails = 0 THEN 'holds' WHEN fails > 0 AND holds = 0 THEN 'fails' END AS verdict FROM (SELECT doc_id FROM documents) LEFT JOIN c USING (doc_id)""")
def reconciled(spark, sf_dir):
    v = lambda c: F.when(c, "holds").otherwise("fails").alias("verdict")
    labels = table(spark, sf_dir, "labels")
    j = labels.select("doc_id", v(F.col("quality") == 1)).unionAll(labels.select("doc_id", v(F.col("toxic") == 0)))
    out = table(spark, sf_dir, "documents").select("doc_id").join(stores.reconciled(j, "doc_id", "verdict"), "doc_id", "left")
    return out.select("doc_id", F.coalesce("holds", F.lit(0)).alias("holds"), F.coalesce("fails", F.lit(0)).alias("fails"), F.coalesce("state", F.lit("Unknown")).alias("state"), "verdict")


@query("A21_store_summary", """
WITH s AS (SELECT lang, CASE WHEN quality IS NULL THEN 'Unknown' WHEN (quality = 1) = (toxic = 0) THEN 'Answered' ELSE 'Contested' END AS state FROM documents LEFT JOIN labels USING (doc_id))
SELECT lang, count(*) AS claims, count(*) FILTER (state = 'Answered') AS answered, count(*) FILTER (state = 'Contested') AS contested, count(*) FILTER (state = 'Unknown') AS unknown FROM s GROUP BY lang""")
def store_summary(spark, sf_dir):
    states = reconciled(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    of = lambda s: F.count_if(F.col("state") == s).alias(s.lower())
    return states.groupBy("lang").agg(F.count("*").alias("claims"), of("Answered"), of("Contested"), of("Unknown"))


@query("A18_scores", f"""
WITH p AS (SELECT toxic, CASE WHEN length(text) < 200 THEN NULL WHEN regexp_matches(lower(text), '(^|[^a-z])(idiot|moron|scum|stupid|trash)([^a-z]|$)') THEN 1 ELSE 0 END AS predicted FROM documents JOIN labels USING (doc_id))
SELECT count(*) AS total, count(predicted) AS answered, count(*) FILTER (predicted = toxic) AS correct, {_share('count(predicted)', 'count(*)')} AS coverage, {_share('count(*) FILTER (predicted = toxic)', 'count(predicted)')} AS accuracy, count(*) FILTER (predicted <> toxic) AS wrong FROM p""")
def scores(spark, sf_dir):
    rule = F.when(F.length("text") >= 200, F.when(F.lower("text").rlike("(^|[^a-z])(idiot|moron|scum|stupid|trash)([^a-z]|$)"), 1).otherwise(0))
    rows = table(spark, sf_dir, "documents").withColumn("predicted", rule).select("doc_id", "predicted").join(table(spark, sf_dir, "labels"), "doc_id")
    return analytics.scored(rows, "toxic", "predicted")


@query("W1_core", "SELECT source, doc_id, rank FROM (SELECT source, doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS INT) AS rank FROM documents) WHERE rank <= 2")
def core(spark, sf_dir):
    return analytics.core(table(spark, sf_dir, "documents"), "source", [F.desc("n_chars"), F.col("doc_id")], 2).select("source", "doc_id", "rank")


@query("A23_totals", "SELECT source, lang, count(*) AS documents, sum(length(text))::BIGINT AS characters FROM documents GROUP BY ROLLUP (source, lang)")
def totals(spark, sf_dir):
    return table(spark, sf_dir, "documents").rollup("source", "lang").agg(F.count("*").alias("documents"), F.sum(F.length("text")).alias("characters"))


_EXPECTED = [("en",), ("fr",), ("de",), ("es",), ("la",)]


@query("U1_completed", f"WITH e AS (SELECT * FROM {values_sql(['lang'], _EXPECTED)}), c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang) SELECT coalesce(e.lang, c.lang) AS lang, coalesce(n, 0) AS n, e.lang IS NOT NULL AS expected FROM e FULL JOIN c ON e.lang = c.lang")
def completed(spark, sf_dir):
    counts = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    return analytics.completed(counts, values(spark, "lang string", _EXPECTED), "lang", "n")


_DECLARED = [(f"src{k}",) for k in range(0, 30, 2)] + [("archive",)]


@query("S3_manifest_gaps", f"WITH m AS (SELECT * FROM {values_sql(['source'], _DECLARED)}) SELECT DISTINCT source, 'unmanifested' AS gap FROM documents WHERE source NOT IN (SELECT source FROM m) UNION ALL SELECT source, 'stale' FROM m WHERE source NOT IN (SELECT source FROM documents)")
def manifest_gaps(spark, sf_dir):
    return corpus.manifest_gaps(values(spark, "source string", _DECLARED), table(spark, sf_dir, "documents"), "source")


@query("K1_merged_manifest", f"WITH m AS (SELECT source, 0 AS n FROM {values_sql(['source'], _DECLARED)}), c AS (SELECT source, count(*) AS n FROM documents WHERE lang = 'es' GROUP BY source) SELECT * FROM c UNION ALL SELECT * FROM m WHERE source NOT IN (SELECT source FROM c)")
def merged_manifest(spark, sf_dir):
    old = values(spark, "source string", _DECLARED).withColumn("n", F.lit(0).cast("bigint"))
    return corpus.merged_manifest(old, table(spark, sf_dir, "documents").where("lang = 'es'").groupBy("source").agg(F.count("*").alias("n")), "source")


@query("A20_conflicts", "SELECT text_hash, n, labels FROM (SELECT sha256(d.text) AS text_hash, count(*) AS n, count(DISTINCT quality * 2 + toxic) AS labels FROM documents d JOIN labels USING (doc_id) GROUP BY 1) WHERE labels > 1")
def conflicts(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("text_hash")).join(table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") * 2 + F.col("toxic")).alias("label")), "doc_id")
    return stores.conflicting_labels(rows, "text_hash", "label")


@query("A14_dispersion", f"""
WITH h AS (SELECT source, count(*) FILTER ({_HIT}) AS n FROM documents GROUP BY source), r AS (SELECT n, row_number() OVER (ORDER BY n DESC, source) AS k FROM h WHERE n > 0)
SELECT count(*) AS works, sum(n)::BIGINT AS gain, {_share('sum(n) FILTER (k <= 3)', 'sum(n)')} AS top3 FROM r""")
def dispersion(spark, sf_dir):
    h = table(spark, sf_dir, "documents").groupBy("source").agg(F.count_if(F.col("text").rlike('[A-Za-z_]+ [=:] "')).alias("n")).where("n > 0")
    top3 = h.orderBy(F.desc("n"), "source").limit(3).agg(F.sum("n").alias("t"))
    return h.agg(F.count("*").alias("works"), F.sum("n").alias("gain")).crossJoin(F.broadcast(top3)).select("works", "gain", share(F.col("t"), F.col("gain")).alias("top3"))
