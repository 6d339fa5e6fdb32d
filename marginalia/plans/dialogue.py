"""Questions Q2 to Q7 over documents, labels and benchmark, and their verification."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import questions as qs
from .registry import query, table

_RX = '([A-Za-z]+) = "([0-9A-Za-z]+)"'


def _store(spark, sf_dir):
    """Labels as records: a record's group is its document's source, its side whether it is not toxic; those of quality 0 are retracted."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    marks = table(spark, sf_dir, "labels").join(d, "doc_id", "left")
    return marks.select(F.col("doc_id").alias("id"), F.coalesce("source", F.lit("")).alias("group"), (F.col("toxic") == 0).alias("side"), F.coalesce(F.col("quality") == 0, F.lit(False)).alias("retracted"))


def _readings(spark, sf_dir):
    read = F.col("text").rlike(_RX)
    roles = F.struct(F.regexp_extract("text", _RX, 1).alias("agent"), F.regexp_extract("text", _RX, 2).alias("recipient"), F.col("lang").alias("theme"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.when(read, roles).alias("roles"))


def _asked(spark, sf_dir):
    """Q2 compares an even document and the next; Q3 asks what a document's conclusion rests on: its own label and that of a tenth of its number; Q4 takes each document's label away; Q7 judges each source."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    store, readings = _store(spark, sf_dir), _readings(spark, sf_dir)
    pairs = d.where("doc_id % 2 = 0").select(F.col("doc_id").alias("q"), F.col("doc_id").alias("a"), (F.col("doc_id") + 1).alias("b"))
    named = d.select(F.col("doc_id").alias("q"), F.explode(F.array_distinct(F.array("doc_id", F.floor(F.col("doc_id") / 10)))).alias("ref"))
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("q"))
    claims = d.where("source is not null").select(F.col("source").alias("q"), F.col("source").alias("claim")).distinct()
    parts = [qs.comparison(pairs, readings), qs.warrant(named, store), qs.counterfactual(d.select(F.col("doc_id").alias("q"), F.col("doc_id").alias("removed")), store), qs.consistency(store), qs.gloss(items), qs.judgement(claims, store)]
    return *qs.asked(*parts), store, readings


_ASKED = f"""
s AS (SELECT l.doc_id AS id, coalesce(source, '') AS g, toxic = 0 AS side, coalesce(quality = 0, false) AS gone FROM labels l LEFT JOIN documents USING (doc_id)),
r AS (SELECT doc_id AS id, CASE WHEN regexp_matches(text, '{_RX}') THEN [regexp_extract(text, '{_RX}', 1), regexp_extract(text, '{_RX}', 2), lang] END AS v FROM documents),
n AS (SELECT g, count(*) FILTER (side) AS holds, count(*) FILTER (NOT side) AS fails FROM s WHERE NOT gone GROUP BY g),
p AS (SELECT doc_id AS q, a.v AS a, b.v AS b FROM documents LEFT JOIN r a ON a.id = doc_id LEFT JOIN r b ON b.id = doc_id + 1 WHERE doc_id % 2 = 0),
w AS (SELECT q, count(*) AS n, count(*) FILTER (s.id IS NULL) AS missing_n, count(*) FILTER (gone) AS gone_n FROM (SELECT doc_id AS q, unnest(list_distinct([doc_id, doc_id // 10])) AS ref FROM documents) LEFT JOIN s ON s.id = ref GROUP BY q),
f AS (SELECT doc_id AS q, s.side, (holds > 0)::INT + (fails > 0)::INT AS before, (holds - CASE WHEN side THEN 1 ELSE 0 END > 0)::INT + (fails - CASE WHEN NOT side THEN 1 ELSE 0 END > 0)::INT AS after FROM documents LEFT JOIN (SELECT * FROM s WHERE NOT gone) s ON s.id = doc_id LEFT JOIN n USING (g)),
j AS (SELECT DISTINCT source AS q, coalesce(holds, 0) AS holds, coalesce(fails, 0) AS fails FROM documents LEFT JOIN n ON n.g = source WHERE source IS NOT NULL),
c AS (SELECT count(*) AS n, count(*) = count(DISTINCT id) AND count(*) FILTER (side IS NULL OR id IS NULL) = 0 AS fine FROM s),
u AS (
SELECT 'Q2' AS type, q::VARCHAR AS q, CASE WHEN a IS NULL OR b IS NULL THEN 'Unknown' ELSE 'Answered' END AS state, CASE WHEN a IS NULL THEN 'left-side-outside-declared-grammar' ELSE 'right-side-outside-declared-grammar' END AS reason, 'a reading of either side' AS missing, CASE WHEN a = b THEN 'SameRelation' WHEN a[1] <> a[2] AND a[1] = b[2] AND a[2] = b[1] AND a[3] = b[3] THEN 'RoleReversal' ELSE 'DifferentRelation' END AS answer FROM p
UNION ALL SELECT 'Q3', q::VARCHAR, CASE WHEN gone_n > 0 THEN 'Unknown' WHEN missing_n > 0 THEN 'Inconsistent' ELSE 'Answered' END, CASE WHEN gone_n > 0 THEN 'warrant-refers-to-retracted-evidence' ELSE 'warrant-names-records-not-in-the-store' END, 'a warrant resting on evidence that is still active', 'present=' || n FROM w
UNION ALL SELECT 'Q4', q::VARCHAR, CASE WHEN side IS NULL THEN 'Unknown' ELSE 'Answered' END, 'no-such-evidence-record', 'the id of a record present in the store', 'survivors=' || after || ';changed=' || (after <> before) FROM f
UNION ALL SELECT 'Q5', 'store', CASE WHEN fine THEN 'Answered' ELSE 'Inconsistent' END, 'duplicate-or-incomplete-records', NULL, 'records=' || n FROM c
UNION ALL SELECT 'Q6', item_id::VARCHAR, 'Refused', '{qs.GLOSS}', NULL, NULL FROM benchmark
UNION ALL SELECT 'Q7', q, CASE WHEN holds > 0 AND fails > 0 THEN 'Contested' WHEN holds + fails > 0 THEN 'Answered' ELSE 'Unknown' END, 'no-judgement-of-this-claim', 'a judgement of the claim', CASE WHEN holds > 0 AND fails > 0 THEN 'holds=' || holds || ';fails=' || fails WHEN holds > 0 THEN 'holds' ELSE 'fails' END FROM j),
asked AS (SELECT type, q, state, CASE WHEN state NOT IN ('Answered', 'Contested') THEN reason END AS reason, CASE WHEN state = 'Unknown' THEN missing END AS missing, CASE WHEN state IN ('Answered', 'Contested') THEN answer END AS answer FROM u)"""


@query("E17_questions", f"WITH {_ASKED} SELECT * FROM asked")
def answers(spark, sf_dir):
    return _asked(spark, sf_dir)[0]


@query("E17_contract", f"WITH {_ASKED} SELECT type, state, count(*) AS n, CAST(0 AS BIGINT) AS broken FROM asked GROUP BY ALL")
def contract(spark, sf_dir):
    """Answers by type and state, and how many break the contract."""
    said, refs, *_ = _asked(spark, sf_dir)
    bad = qs.violations(said, refs).select("type", "q", F.lit(1).alias("bad"))
    return said.join(bad, ["type", "q"], "left").groupBy("type", "state").agg(F.count("*").alias("n"), F.count("bad").alias("broken"))


@query("E17_verified", f"""WITH {_ASKED}, x AS (SELECT * FROM asked WHERE type IN ('Q2', 'Q3', 'Q4', 'Q7') AND state IN ('Answered', 'Contested') AND length(q || answer) % 5 = 0)
SELECT type, q, 'said' AS side, answer || '!' AS answer FROM x UNION ALL SELECT type, q, 'follows', answer FROM x""")
def verified(spark, sf_dir):
    """Some answers altered by rule: the verifier finds these, says what follows instead, and finds no other."""
    said, refs, store, readings = _asked(spark, sf_dir)
    altered = said.withColumn("answer", F.when(F.length(F.concat("q", "answer")) % 5 == 0, F.concat("answer", F.lit("!"))).otherwise(F.col("answer")))
    altered = altered.withColumn("answer", F.when(F.col("type").isin("Q2", "Q3", "Q4", "Q7"), F.col("answer")))
    return qs.verified(altered, refs, store, readings).select("type", "q", "side", "answer")
