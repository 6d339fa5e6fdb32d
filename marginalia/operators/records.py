"""Log lines with issues, redirects and chains of pages, inquiries and their answers, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import u16len
from . import finite, stores

EVIDENCE = "schema string, id string, grammar string, text string, expected struct<agent:string,recipient:string,theme:string>, contentHash string, targetId string, reason string"
# Numerals of volume names.
NUMERALS = {c: k for k, c in enumerate("〇一二三四五六七八九")}


def evidence_lines(lines: DataFrame, record_schema: str, retraction_schema: str) -> DataFrame:
    """Lines (line, raw) parsed, with the first issue of each: bad-json, wrong-schema, hash-mismatch, or null.

    The line number is a column, since the lines of a file have no other order.
    """
    parsed = lines.withColumn("_c", F.from_json("raw", EVIDENCE + ", _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"}))
    r = parsed.select("line", "_c.*")
    own = stores.content_hash(F.col("grammar"), F.col("text"), F.col("expected"))
    issue = F.when(F.col("_corrupt_record").isNotNull() | F.col("schema").isNull() & F.col("id").isNull(), "bad-json").when(~F.coalesce(F.col("schema").isin(record_schema, retraction_schema), F.lit(False)), "wrong-schema").when((F.col("schema") == record_schema) & ~own.eqNullSafe(F.col("contentHash")), "hash-mismatch")
    return r.withColumn("issue", issue).withColumn("kind", F.when(issue.isNull(), F.when(F.col("schema") == record_schema, "evidence").otherwise("retraction"))).drop("_corrupt_record")


def resolved(pages: DataFrame, redirects: DataFrame, hops: int = 3) -> DataFrame:
    """pages (name) with the name after at most hops redirects (from, to)."""
    out = pages.withColumn("target", F.col("name"))
    for k in range(hops):
        r = redirects.select(F.col("from").alias(f"_f{k}"), F.col("to").alias(f"_t{k}"))
        out = out.join(r, F.col("target") == F.col(f"_f{k}"), "left").withColumn("target", F.coalesce(f"_t{k}", "target")).drop(f"_f{k}", f"_t{k}")
    return out


def volume_key(name: Column) -> Column:
    """Number of a volume from numerals up to 99; null if there are none."""
    digits = F.regexp_extract(name, "([〇一二三四五六七八九十]+)", 1)
    of = F.create_map(*[x for c, k in NUMERALS.items() for x in (F.lit(c), F.lit(k))])
    tens, ones = F.substring_index(digits, "十", 1), F.substring_index(digits, "十", -1)
    with_ten = F.when(tens == "", 1).otherwise(of[tens]) * 10 + F.when(ones == "", 0).otherwise(of[ones])
    return F.when(digits == "", None).when(F.contains(digits, F.lit("十")), with_ten).otherwise(of[digits])


# The inquiry of a head and, perhaps, one of its nine places.
TERNARY = "^(?:觀|观)「([^」]+)」(?:之([一二三四五六七八九])(?:贊|赞))?。?$"


def ternary_inquiry(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """rows (id, text) of inquiries 觀「head」, with 之N贊 or without, joined to heads (name, digits): status, reason, digits, zan, address (null without a zan)."""
    hit = F.coalesce(F.col("text").rlike(TERNARY), F.lit(False))
    zan = F.instr(F.lit("一二三四五六七八九"), F.regexp_extract("text", TERNARY, 2))
    out = rows.withColumn("name", F.when(hit, F.regexp_extract("text", TERNARY, 1))).withColumn("zan", F.when(hit & (F.regexp_extract("text", TERNARY, 2) != ""), zan)).join(heads, "name", "left")
    there = F.col("digits").isNotNull()
    reason = F.when(F.col("name").isNull(), "outside-declared-query-grammar").when(~there, "unknown-head")
    address = F.concat("digits", F.lpad(F.conv((F.col("zan") - 1).cast("string"), 10, 3), 2, "0"))
    return out.select("id", F.when(there, "IndexedText").otherwise("Unknown").alias("status"), reason.alias("reason"), "digits", F.when(there, F.col("zan")).alias("zan"), address.alias("address"))


# The inquiry of a name and, perhaps, one of its six lines, in the order of the lines.
HEXAGRAM, LINES = "^(?:觀|观)「([^「」\\r\\n]{1,12})」(?:之([初二三四五上])爻)?。?$", "初二三四五上"


def hexagram_inquiry(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """rows (id, text) of inquiries 觀「name」(之N爻) against catalog (name, bits): the word, the line and the word with that line changed."""
    rx = HEXAGRAM
    hit = F.coalesce((F.length("text") <= 128) & F.col("text").rlike(rx), F.lit(False))
    at = F.instr(F.lit(LINES), F.regexp_extract("text", rx, 2))
    out = rows.withColumn("name", F.when(hit, F.regexp_extract("text", rx, 1))).withColumn("position", F.when(hit & (F.regexp_extract("text", rx, 2) != ""), at))
    out = out.join(catalog, "name", "left").withColumn("changed", F.when(F.col("position").isNotNull(), finite.flipped(F.col("bits"), F.col("position"))))
    target = catalog.select(F.col("bits").alias("changed"), F.col("name").alias("target"))
    out = out.join(target, "changed", "left")
    return out.select("id", F.when(F.col("bits").isNotNull(), "IndexedText").otherwise("Unknown").alias("status"), F.when(F.col("name").isNull(), "outside-changes-inquiry-grammar").when(F.col("bits").isNull(), "hexagram-name-not-in-catalog").alias("reason"), "bits", "position", "changed", "target")


# A clause, and the longest text in UTF-16 units.
CLAUSE = "^(凡|有)「([^「」\\r\\n]{1,32})」(皆非|皆|非|為|为)「([^「」\\r\\n]{1,32})」$"
MAX_SYLLOGISM = 512


def syllogism_text(rows: DataFrame) -> DataFrame:
    """rows (id, text) of two premises and a conclusion: status, reason, mood and figure; the reason is the first that holds."""
    cut = F.split("text", "。", -1)
    parts = F.when(F.element_at(cut, -1) == "", F.slice(cut, 1, F.greatest(F.size(cut) - 1, F.lit(0)))).otherwise(cut)
    parts = F.when(u16len(F.col("text")) <= MAX_SYLLOGISM, parts)
    out = rows.select("id", "text", parts.alias("_p"))
    three = F.coalesce((F.size("_p") == 3) & F.get("_p", F.lit(2)).startswith("故"), F.lit(False))
    clause = lambda k: F.get("_p", F.lit(k)) if k < 2 else F.substring(F.get("_p", F.lit(2)), 2, 600)
    of = lambda k, g: F.regexp_extract(clause(k), CLAUSE, g)
    kind = lambda k: F.when((of(k, 1) == "凡") & (of(k, 3) == "皆"), "A").when((of(k, 1) == "凡") & (of(k, 3) == "皆非"), "E").when((of(k, 1) == "有") & of(k, 3).isin("為", "为"), "I").when((of(k, 1) == "有") & (of(k, 3) == "非"), "O")
    out = out.select("id", "text", "_p", three.alias("_three"), *[kind(k).alias(f"_k{k}") for k in range(3)], *[of(k, g).alias(f"_{'s' if g == 2 else 'o'}{k}") for k in range(3) for g in (2, 4)])
    fits = F.col("_k0").isNotNull() & F.col("_k1").isNotNull() & F.col("_k2").isNotNull()
    terms = F.array_distinct(F.array(*[f"_{e}{k}" for k in range(3) for e in "so"]))
    s, p = F.col("_s2"), F.col("_o2")
    middle = F.get(F.filter(terms, lambda x: (x != s) & (x != p)), F.lit(0))
    wires = {1: ((middle, p), (s, middle)), 2: ((p, middle), (s, middle)), 3: ((middle, p), (middle, s)), 4: ((p, middle), (middle, s))}
    figure = F.lit(None).cast("int")
    for n, ((a, b), (c, d)) in wires.items():
        figure = F.when((F.col("_s0") == a) & (F.col("_o0") == b) & (F.col("_s1") == c) & (F.col("_o1") == d), n).otherwise(figure)
    out = out.withColumn("_figure", figure)
    reason = (
        F.when(F.col("_p").isNull(), "outside-syllogism-grammar").when(~F.col("_three"), "expected-two-premises-and-conclusion").when(~fits, "outside-syllogism-grammar")
        .when((F.size(terms) != 3) | (s == p), "requires-three-distinct-term-names").when(F.col("_figure").isNull(), "not-a-standard-figure-in-declared-premise-order")
    )
    out = out.withColumn("reason", reason)
    good = F.col("reason").isNull()
    return out.select("id", F.when(good, "Parsed").otherwise("Unknown").alias("status"), "reason", F.when(good, F.concat("_k0", "_k1", "_k2")).alias("mood"), F.when(good, F.col("_figure")).alias("figure"))


def warranted(claims: DataFrame, records: DataFrame, retractions: DataFrame) -> DataFrame:
    """claims (claim, ref) with the fate of each reference: present, retracted or missing."""
    r = records.select(F.col("id").alias("ref"), F.lit(True).alias("_there"))
    t = retractions.select(F.col("target_id").alias("ref"), F.lit(True).alias("_gone")).distinct()
    out = claims.join(r, "ref", "left").join(t, "ref", "left")
    return out.select("claim", "ref", F.when(F.col("_there").isNull(), "missing").when(F.col("_gone").isNotNull(), "retracted").otherwise("present").alias("state"))


def answered(questions: DataFrame, comparison: Column) -> DataFrame:
    """questions (id, type, ...) to states; a type that is not declared, and a gloss, is refused."""
    state = F.when(F.col("type") == "comparison", F.when(comparison == "Unknown", "Unknown").otherwise("Answered")).when(F.col("type") == "gloss", "Refused").otherwise("Refused")
    reason = F.when(F.col("type") == "gloss", "glosses-are-not-licensed").when(F.col("type") != "comparison", "undeclared-question-type")
    return questions.select("id", state.alias("state"), reason.alias("reason"), F.when(F.col("type") == "comparison", comparison).alias("answer"))


def gates(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row per gate: violations counted in one pass over rows, and whether it holds."""
    one = rows.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(k) for k, c in rules.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("gate"), F.col(k).alias("violations"), (F.col(k) == 0).alias("holds")) for k in rules])).alias("g")).select("g.*")


def seeded(rows: DataFrame, construction: str, work: str, order: str, cap: int) -> DataFrame:
    """Rows to label: per construction the first of each work before the second of any, cap of them."""
    in_work = F.row_number().over(Window.partitionBy(construction, work).orderBy(order))
    ranked = rows.withColumn("_k", in_work).where(F.col("_k") <= cap)  # a limit Spark applies before the shuffle
    return ranked.withColumn("rank", F.row_number().over(Window.partitionBy(construction).orderBy("_k", order))).where(F.col("rank") <= cap).drop("_k")
