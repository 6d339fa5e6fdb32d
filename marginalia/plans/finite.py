"""Generated form: no input tables; the SQL generates the same ranges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import finite
from ..sources.fixtures import values, values_sql
from .registry import query

_WORDS = """(SELECT n AS code, concat(n & 1, (n >> 1) & 1, (n >> 2) & 1, (n >> 3) & 1, (n >> 4) & 1, (n >> 5) & 1) AS bits FROM range(64) r(n))"""


@query("X1_words", f"""SELECT code, bits, translate(bits, '01', '10') AS complement, reverse(bits) AS reverse, concat(substr(bits, 4, 3), substr(bits, 1, 3)) AS exchange FROM {_WORDS}""")
def words(spark, sf_dir):
    return finite.words(spark)


@query("X2_line_context", f"""
SELECT bits, position, CASE WHEN own = '1' THEN 'yang' ELSE 'yin' END AS polarity, substr(bits, 1, 3) AS lower, substr(bits, 4, 3) AS upper,
  position IN (2, 5) AS central, CAST(own AS INT) = position % 2 AS proper, pair AS corresponding, own <> substr(bits, pair, 1) AS opposite,
  concat(substr(bits, 1, position - 1), CASE own WHEN '1' THEN '0' ELSE '1' END, substr(bits, position + 1)) AS changed
FROM (SELECT bits, p AS position, substr(bits, p, 1) AS own, CASE WHEN p <= 3 THEN p + 3 ELSE p - 3 END AS pair FROM {_WORDS}, (SELECT CAST(range AS INT) AS p FROM range(1, 7)))""")
def line_context(spark, sf_dir):
    return finite.line_context(spark)


@query("X3_pairing_route", """
WITH RECURSIVE e(relation, a, b) AS (VALUES ('strata', 1, 2), ('strata', 3, 4), ('strata', 5, 6), ('correspondence', 1, 4), ('correspondence', 2, 5), ('correspondence', 3, 6)),
both_ways AS (SELECT * FROM e UNION ALL SELECT relation, b, a FROM e),
route(step, position) AS (SELECT 0, 1 UNION ALL SELECT step + 1, b FROM route JOIN both_ways ON a = position AND relation = CASE WHEN step % 2 = 0 THEN 'strata' ELSE 'correspondence' END WHERE step < 6)
SELECT step, position FROM route""")
def pairing_route(spark, sf_dir):
    return finite.pairing_route(spark)


@query("X5_moods", """
SELECT CAST(n AS INT) AS ordinal, concat(a, b, c) AS mood, concat(ka[1], kb[1], kc[1], ka[2], kb[2], kc[2]) AS bits FROM (
SELECT n, a, b, c, code[a] AS ka, code[b] AS kb, code[c] AS kc FROM (
SELECT n, substr('AEIO', n // 16 + 1, 1) AS a, substr('AEIO', (n // 4) % 4 + 1, 1) AS b, substr('AEIO', n % 4 + 1, 1) AS c, MAP {'A': '11', 'E': '10', 'I': '01', 'O': '00'} AS code FROM range(64) r(n)))""")
def moods(spark, sf_dir):
    return finite.moods(spark)


def _proposition(kind: str, s: str, p: str) -> str:
    inside, outside = f"(mask & (term[{s}] & term[{p}])) <> 0", f"(mask & (term[{s}] & (255 - term[{p}]))) <> 0"
    return f"CASE {kind} WHEN 'A' THEN NOT ({outside}) WHEN 'E' THEN NOT ({inside}) WHEN 'I' THEN {inside} ELSE {outside} END"


@query("X6_syllogism_atlas", f"""
WITH k AS (SELECT unnest(['A', 'E', 'I', 'O']) AS k),
wires(figure, a1, a2, b1, b2) AS (VALUES (1, 2, 3, 1, 2), (2, 3, 2, 1, 2), (3, 2, 3, 2, 1), (4, 3, 2, 2, 1)),
m AS (SELECT a.k || b.k || c.k AS mood, figure, policy, CAST(mask AS INT) AS mask, [170, 204, 240] AS term, a1, a2, b1, b2
  FROM k a, k b, k c, wires, (SELECT unnest(['boolean', 'terms-nonempty']) AS policy), range(1, 256) r(mask)),
t AS (SELECT mood, figure, policy, mask, policy = 'boolean' OR ((mask & 170) <> 0 AND (mask & 204) <> 0 AND (mask & 240) <> 0) AS admissible,
  {_proposition("mood[1]", "a1", "a2")} AS major, {_proposition("mood[2]", "b1", "b2")} AS minor, {_proposition("mood[3]", "1", "3")} AS conclusion FROM m),
g AS (SELECT mood, figure, policy, min(mask) FILTER (admissible AND major AND minor AND NOT conclusion) AS countermodel, count(*) FILTER (admissible) AS admissible, count(*) FILTER (admissible AND major AND minor) AS satisfied FROM t GROUP BY ALL)
SELECT mood, figure, policy, CASE WHEN countermodel IS NULL THEN 'Valid' ELSE 'Refuted' END AS status, coalesce(countermodel, 255) AS checked, countermodel,
  CASE WHEN countermodel IS NULL THEN admissible END AS admissible, CASE WHEN countermodel IS NULL THEN satisfied END AS satisfied FROM g""")
def syllogism_atlas(spark, sf_dir):
    return finite.syllogism_atlas(spark)


_TERNARY = "concat(({x}) // 27 % 3, ({x}) // 9 % 3, ({x}) // 3 % 3, ({x}) % 3)"


@query("X7_addresses", f"""
SELECT head, zan, digits, digits || concat((zan - 1) // 3, (zan - 1) % 3) AS address, CAST(substr(digits, 1, 1) AS INT) AS fang, CAST(substr(digits, 2, 1) AS INT) AS zhou,
  CAST(substr(digits, 3, 1) AS INT) AS bu, CAST(substr(digits, 4, 1) AS INT) AS jia, (zan - 1) // 3 AS phase_group, (zan - 1) % 3 AS phase_within, CASE WHEN zan < 9 THEN zan + 1 END AS next_zan
FROM (SELECT CAST(n // 9 + 1 AS INT) AS head, CAST(n % 9 + 1 AS INT) AS zan, {_TERNARY.format(x="n // 9")} AS digits FROM range(729) r(n))""")
def addresses(spark, sf_dir):
    return finite.addresses(spark)


_CODES = [("000000",), ("000022",), ("222222",), ("120121",), ("12012",), ("000003",)]


@query("X7_decoded", f"""
SELECT code, CASE WHEN ok THEN CAST(substr(code, 1, 1) AS INT) * 27 + CAST(substr(code, 2, 1) AS INT) * 9 + CAST(substr(code, 3, 1) AS INT) * 3 + CAST(substr(code, 4, 1) AS INT) + 1 END AS head,
  CASE WHEN ok THEN CAST(substr(code, 5, 1) AS INT) * 3 + CAST(substr(code, 6, 1) AS INT) + 1 END AS zan
FROM (SELECT code, regexp_matches(code, '^[012]{{6}}$') AS ok FROM {values_sql(["code"], _CODES)})""")
def decoded(spark, sf_dir):
    rows = values(spark, "code string", _CODES).withColumn("d", finite.decoded(F.col("code")))
    return rows.select("code", "d.head", "d.zan")


@query("X9_residues", """
SELECT CAST(n AS INT) AS x, concat_ws(',', n % 1, n % 2, n % 3, n % 4) AS standard, concat_ws(',', 1, CASE WHEN n % 2 = 0 THEN 2 ELSE n % 2 END, CASE WHEN n % 3 = 0 THEN 3 ELSE n % 3 END, CASE WHEN n % 4 = 0 THEN 4 ELSE n % 4 END) AS positive FROM range(200) r(n)""")
def residues(spark, sf_dir):
    x = F.col("id").cast("int")
    text = lambda a: F.array_join(F.transform(a, lambda v: v.cast("string")), ",")
    return spark.range(200).select(x.alias("x"), text(finite.residues(x, [1, 2, 3, 4])).alias("standard"), text(finite.residues(x, [1, 2, 3, 4], positive=True)).alias("positive"))


@query("X9_reconstruction", "SELECT CAST(n AS INT) AS x, CAST(n % 3 AS INT) AS ra, CAST(n % 4 AS INT) AS rb, CAST((n % 3 * 4 + n % 4 * 9) % 12 AS INT) AS back FROM range(12) r(n)")
def reconstruction(spark, sf_dir):
    return finite.reconstructed(spark, 3, 4)


@query("A24_fibres", """
WITH f(family, observation, x) AS (
SELECT 0, concat_ws(',', n % 3, n % 4), n FROM range(12) r(n) UNION ALL SELECT 1, concat_ws(',', n % 1, n % 3, n % 4), n FROM range(12) r(n)
UNION ALL SELECT 2, concat_ws(',', n % 2, n % 3), n FROM range(12) r(n))
SELECT family, observation, string_agg(CAST(x AS VARCHAR), ',' ORDER BY x) AS members, count(*) AS n FROM f GROUP BY ALL""")
def fibres(spark, sf_dir):
    return finite.fibres(spark, [[3, 4], [1, 3, 4], [2, 3]], 12)


@query("X10_octaves", """
SELECT CAST(n AS INT) AS n, round(p, 9) AS place, CAST(near AS INT) AS nearest, round(least(abs(p - near / 22.0::DOUBLE), 1 - abs(p - near / 22.0::DOUBLE)), 9) AS distance FROM (
SELECT n, p, CAST(floor(p * 22 + 0.5) AS INT) % 22 AS near FROM (SELECT n, log2(n) - floor(log2(n)) AS p FROM range(1, 129) r(n)))""")
def octaves(spark, sf_dir):
    return finite.octaves(spark, 128)
