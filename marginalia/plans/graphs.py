"""Late evidence as a stream, frequent runs of words, chains of pages, and the Monte-Carlo null, over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.text import tokens
from ..operators import chains, ngrams, nulls
from ..sources.tables import shared_dir
from ..streaming import evidence
from .registry import query, table


@query("T2_late_evidence", """
WITH j AS (SELECT user_id AS claim, event_id, event_type = 'error' AS against, value >= 100 AS stands FROM events),
s AS (SELECT claim, count(*) FILTER (stands AND NOT against) AS speaks_for, count(*) FILTER (stands AND against) AS speaks_against, min(event_id) FILTER (NOT against) AS f, min(event_id) FILTER (against) AS a FROM j GROUP BY claim)
SELECT claim, speaks_for, speaks_against, CASE WHEN f IS NOT NULL AND a IS NOT NULL THEN greatest(f, a) END AS since,
CASE WHEN speaks_for > 0 AND speaks_against > 0 THEN 'Contested' WHEN speaks_for + speaks_against > 0 THEN 'Answered' ELSE 'Unknown' END AS state FROM s""")
def late_evidence(spark, sf_dir):
    """events as a log of judgements, errors against a user, and of retractions of what is under 100; replayed as a stream of four batches without any order, so retractions come before what they withdraw and contradictions late. The last states are those of the batch plan.

    The horizon and the lateness cover the table's thirty days twice, since the batches mix all of it.
    """
    e = table(spark, sf_dir, "events")
    log = evidence.evidence_log(e, F.col("user_id"), F.col("event_id"), F.col("event_type") == "error", F.col("ts"), F.col("value") < 100)
    base = f"{shared_dir(spark)}/claims-{uuid.uuid4().hex}"
    for part in range(4):  # each a mix of all times
        log.where(F.pmod(F.xxhash64("id", "kind"), F.lit(4)) == part).write.parquet(f"{base}/log/part={part}")
    files = len(spark.read.schema(evidence.LOG).option("recursiveFileLookup", "true").parquet(f"{base}/log").inputFiles())
    stream = spark.readStream.schema(evidence.LOG).option("maxFilesPerTrigger", max(1, -(-files // 4))).option("recursiveFileLookup", "true").parquet(f"{base}/log")
    evidence.run_claims(stream, f"{base}/out", f"{base}/state", "60 days", "60 days").awaitTermination()
    return evidence.latest(spark.read.parquet(f"{base}/out"))


_WORDS = "list_filter(regexp_split_to_array(lower(text), '[^a-z0-9_]+'), lambda x: x <> '')"


_RUNS = " UNION ALL ".join(f"SELECT {k} AS k, concat_ws(' ', {', '.join(f'x{j}' for j in range(1, k + 1))}) AS gram, concat_ws(' ', {', '.join(f'x{j}' for j in range(1, k))}) AS p, concat_ws(' ', {', '.join(f'x{j}' for j in range(2, k + 1))}) AS s FROM l WHERE x{k} IS NOT NULL" for k in range(2, 9))


@query("A9_unsuppressed", f"""
WITH t AS (SELECT doc_id, {_WORDS} AS w FROM documents), u AS (SELECT doc_id, unnest(w) AS x1, unnest(range(1, len(w) + 1)) AS i FROM t),
l AS (SELECT x1, {', '.join(f'lead(x1, {k - 1}) OVER v AS x{k}' for k in range(2, 9))} FROM u WINDOW v AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT k, gram, count(*) AS n, any_value(p) AS p, any_value(s) AS s FROM ({_RUNS}) GROUP BY k, gram HAVING count(*) >= 8),
o AS (SELECT * FROM c ANTI JOIN (SELECT k - 1 AS k, n, unnest([p, s]) AS gram FROM c) e USING (k, gram, n))
SELECT CAST(row_number() OVER (ORDER BY n DESC, k DESC, gram) AS INT) AS rank, gram, n FROM o ORDER BY rank LIMIT 40""")
def unsuppressed(spark, sf_dir):
    """The report of 40 runs of two to eight words that occur eight times or more, without those that a longer run holds as often."""
    return ngrams.top_closed(table(spark, sf_dir, "documents"), "doc_id", tokens(F.col("text")))


_LINKS = r"""html_links AS (SELECT page_id AS id, regexp_replace(lower(split_part(trim(regexp_extract(html, '<h1>([^<]*)</h1>', 1)), ' ', 1)), '[.,#%*$&].*', '') AS name, list_transform(regexp_extract_all(html, '<a href="/([^"]*)"', 1), lambda x: regexp_replace(lower(x), '[.,#%*$&].*', '')) AS links FROM pages),
holders AS (SELECT name, min(id) AS holder FROM html_links WHERE name <> '' GROUP BY name),
f AS (SELECT id, i, holder FROM (SELECT id, unnest(links) AS link, unnest(range(len(links))) AS i FROM html_links) JOIN holders ON name = link WHERE holder <> id),
n AS (SELECT id, arg_min(holder, i) AS t FROM f GROUP BY id),
e AS (SELECT p.id, h.holder < p.id AS redirect, CASE WHEN h.holder < p.id THEN h.holder ELSE n.t END AS t FROM html_links p LEFT JOIN holders h USING (name) LEFT JOIN n ON n.id = p.id),
e1 AS (SELECT id, coalesce(redirect, false) AS redirect, t FROM e)"""


def _page_edges(spark, sf_dir):
    named = lambda c: F.regexp_replace(F.lower(c), "[.,#%*$&].*", "")
    name = named(F.split_part(F.trim(F.regexp_extract("html", "<h1>([^<]*)</h1>", 1)), F.lit(" "), F.lit(1)))
    links = F.transform(F.regexp_extract_all("html", F.lit('<a href="/([^"]*)"'), F.lit(1)), named)
    return chains.next_pages(table(spark, sf_dir, "pages"), "page_id", name, links)


@query("K4_chain", f"""
WITH RECURSIVE {_LINKS},
walk(start, page, seen, step, redirect) AS (SELECT id, id, [id], CAST(0 AS BIGINT), redirect FROM e1 WHERE id NOT IN (SELECT t FROM e1 WHERE t IS NOT NULL)
UNION ALL SELECT start, e1.t, list_append(seen, e1.t), step + CASE WHEN e1.redirect THEN 0 ELSE 1 END, x.redirect FROM walk JOIN e1 ON e1.id = page JOIN e1 x ON x.id = e1.t WHERE NOT list_contains(seen, e1.t))
SELECT start, step, page FROM walk WHERE NOT redirect""")
def page_chains(spark, sf_dir):
    """The pages of every chain of pages, from each page that no other leads to: in order, through redirects, once around a cycle."""
    edges = _page_edges(spark, sf_dir)
    led_to = edges.where("to is not null").select(F.col("to").alias("id")).distinct()
    return chains.chain_orders(edges, edges.select("id").join(led_to, "id", "left_anti"))


@query("K4_chain_ends", f"""
WITH RECURSIVE {_LINKS},
walk(start, page, seen, hops, steps) AS (SELECT id, id, [id], CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM e1
UNION ALL SELECT start, e1.t, list_append(seen, e1.t), hops + 1, steps + CASE WHEN e1.redirect THEN 0 ELSE 1 END FROM walk JOIN e1 ON e1.id = page WHERE e1.t IS NOT NULL AND NOT list_contains(seen, e1.t)),
l AS (SELECT start, arg_max(page, hops) AS last, arg_max(seen, hops) AS seen, max(hops) AS hops FROM walk GROUP BY start),
x AS (SELECT l.start, l.last, l.seen, l.hops, e1.t, list_position(l.seen, e1.t) AS at_ FROM l JOIN e1 ON e1.id = l.last)
SELECT x.start AS id, e1.redirect, CASE WHEN x.t IS NULL THEN x.last END AS "end", CASE WHEN x.t IS NULL THEN x.hops ELSE CAST(at_ - 1 AS BIGINT) END AS hops, w.steps,
CASE WHEN x.t IS NOT NULL THEN list_min(x.seen[at_:]) END AS cycle, x.t IS NOT NULL AND at_ = 1 AS on_cycle, CASE WHEN x.t IS NULL THEN 'end' ELSE 'loop' END AS stop
FROM x JOIN e1 ON e1.id = x.start JOIN walk w ON w.start = x.start AND w.hops = CASE WHEN x.t IS NULL THEN x.hops ELSE at_ - 1 END""")
def chain_ends(spark, sf_dir):
    """Where every page's chain comes to: the last page, or a cycle and the way to it."""
    return chains.resolved_chains(_page_edges(spark, sf_dir))


_TARGETS, _NEAR, _TRIALS = 22, 0.0005, 2000


def _mix_sql(x: str) -> str:
    step = lambda h, by, shift: f"((xor({h}, {h} >> {shift}) * {by}::UBIGINT) & 4294967295)"
    return f"list_transform(list_transform(list_transform([({x})::UBIGINT], lambda h: {step('h', nulls.MIX_1, 16)}), lambda h: {step('h', nulls.MIX_2, 13)}), lambda h: xor(h, h >> 16))[1]"


@query("A25_monte_carlo", f"""
WITH p AS (SELECT p_partkey::UBIGINT AS i, log2(p_retailprice) - floor(log2(p_retailprice)) AS x FROM part WHERE p_retailprice > 0),
t AS (SELECT k, k / {_TARGETS}.0::DOUBLE AS y FROM range({_TARGETS}) r(k)),
observed AS (SELECT count(DISTINCT k) AS observed FROM p, t WHERE least(abs(x - y), 1 - abs(x - y)) <= {_NEAR}),
d AS (SELECT i, {_mix_sql('xor(i & 4294967295, ' + _mix_sql('i >> 32') + ')')} AS f FROM p),
r AS (SELECT trial, {_mix_sql(f'xor(f, (trial * {nulls.GOLDEN}::UBIGINT) & 4294967295)')} / 4294967296.0::DOUBLE AS u FROM d, (SELECT unnest(range(1, {_TRIALS + 1}))::UBIGINT AS trial)),
near AS (SELECT trial, CAST(round(u * {_TARGETS}) AS INT) % {_TARGETS} AS k FROM r WHERE abs(u - round(u * {_TARGETS}) / {_TARGETS}.0::DOUBLE) <= {_NEAR}),
n AS (SELECT trial, coalesce(n, 0) AS n FROM (SELECT unnest(range(1, {_TRIALS + 1}))::UBIGINT AS trial) LEFT JOIN (SELECT trial, count(DISTINCT k) AS n FROM near GROUP BY trial) USING (trial))
SELECT CAST(any_value(observed) AS INT) AS observed, count(*) AS trials, count(*) FILTER (n = {_TARGETS}) AS "full", round(count(*) FILTER (n = {_TARGETS}) / count(*)::DOUBLE, 4) AS share, CAST(min(n) AS INT) AS least, CAST(max(n) AS INT) AS greatest, CAST(sum(n) AS BIGINT) AS reached, count(*) FILTER (n >= observed) AS as_many FROM n, observed""")
def monte_carlo(spark, sf_dir):
    """Do the parts' prices, as places in an octave, reach more of 22 targets than as many random places do, in 2,000 trials?"""
    p = table(spark, sf_dir, "part").where("p_retailprice > 0").select("p_partkey", (F.log2("p_retailprice") - F.floor(F.log2("p_retailprice"))).alias("x"))
    return nulls.coverage_null(p, "p_partkey", F.col("x"), [k / _TARGETS for k in range(_TARGETS)], _NEAR, _TRIALS)
