"""Chapter routes and catalogs over small texts made by rule, and the calibration of the relation reader."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalogs, relations, routes
from ..sources.fixtures import values, values_sql
from .fixtures import _FORMS, _training
from .registry import query

PAGES = [
    ("書", "序 [[學而]] [[書/卷一|一]]\n== 目錄 ==\n# [[書/卷二|卷之二]] [[/卷三]]\n# [[學而]]\n* [[為政#頭|為政篇]] [[Category:甲]] [[s:乙]]\n=== 次 ===\n# [[../卷四]] [[書/卷二]]"),
    ("集", "* [[無此頁]] [[為政]]\n文 [[八佾]]\n * [[八佾]]\n==目次==\n[[里仁| 里仁第四 ]]"),
    ("空", ""),
    ("書/卷二", "x"),
    ("書/卷三 校", "x"),
    ("為政", "x"),
    ("學而", "x"),
    ("八佾", "x"),
]
CONTAINERS = [
    (0, "書/一", "== 甲 ==\n{{:書/子}}\n{{: 書/丑 }}\n==乙==\n==丙==\n{{:書/子}}\n{{:書/寅}}"),
    (1, "書/二", "文\n== 丁 ==\n{{:書/丑}}\n{{:書/校勘}}\n{{:書/卯}}\n== 戊 =="),
]
_P, _C = values_sql(["title", "content"], PAGES), values_sql(["ord", "title", "content"], CONTAINERS)


def _pages(spark):
    return values(spark, "title string, content string", PAGES)


@query("K4_main_page_links")
def main_page_links(spark, sf_dir):
    return routes.main_page_links(_pages(spark), "四$")


@query("K4_list_links")
def list_links(spark, sf_dir):
    return routes.list_links(_pages(spark), _pages(spark))


@query("K4_toc_links")
def toc_links(spark, sf_dir):
    return routes.toc_links(_pages(spark))


@query("K4_prefix", f"SELECT substr(title, 3) AS chapter, title AS page FROM {_P} WHERE starts_with(title, '書/') AND NOT regexp_matches(title, '校')")
def prefix(spark, sf_dir):
    return routes.by_prefix(_pages(spark), "書/", exclude="校")


@query("K4_prefix_preferred", f"SELECT substr(title, 3) AS chapter, title AS page FROM {_P} WHERE starts_with(title, '書/') AND regexp_matches(title, '校$')")
def prefix_preferred(spark, sf_dir):
    return routes.by_prefix(_pages(spark), "書/", prefer="校$")


@query("K4_single", f"SELECT title AS chapter, title AS page FROM {_P} WHERE title = '為政'")
def single(spark, sf_dir):
    return routes.single(_pages(spark), "為政")


@query("K4_containers")
def containers(spark, sf_dir):
    return routes.container_chain(values(spark, "ord int, title string, content string", CONTAINERS), "書", "校勘")


def words() -> list[tuple[str, int, str]]:
    """Passages of 64 sections, made by rule; sections 5 to 9 have a fault each."""
    rows, names = [], list(catalogs.TRIGRAMS)
    for k in range(64):
        low, high = names[k // 8], names[k % 8]
        bits = catalogs.TRIGRAMS[low] + catalogs.TRIGRAMS[high]
        if k == 4:
            bits = bits[:-1] + str(1 - int(bits[-1]))
        digit = ["九" if b == "1" else "六" for b in bits]
        labels = ["初" + digit[0], *[digit[i] + "二三四五"[i - 1] for i in range(1, 5)], "上" + digit[5]]
        lines = [f"{x}：文{i}\U00020000。" for i, x in enumerate(labels)]
        if k == 5:
            lines.pop()
        if k == 6:
            lines[0], lines[1] = lines[1], lines[0]
        if k < 2 or k == 7:
            lines.append(("用九" if k != 1 else "用六") + "，終")
        rows.append((f"s{k}", k + 1, f"易經：卦{k}\n" + "\n".join(lines)))
        rows.append((f"s{k}", k + 1, f"{low}下{high}上"))
        if k == 8:
            rows.append((f"s{k}", k + 1, "易經：又"))
    return rows


@query("R16_change_catalog")
def change_catalog(spark, sf_dir):
    out = catalogs.change_catalog(values(spark, "section string, ordinal int, text string", words()))
    return out.select("section", "ordinal", "bits", "statement", F.transform("lines", lambda s: F.concat_ws("|", s["label"], s["text"], s["start"], s["stop"])).alias("lines"), F.size("extra").alias("extra"), "issue")


def heads() -> str:
    """A text of 81 heads of nine places, made by rule; every 20th place has no mark, head 3 another mark, head 9 another last label."""
    out, at = ["前言\n== 玄首序 ==\n序\n"], 0
    for k in range(81):
        if k % 27 == 0:
            out.append(f"== {catalogs.REGIONS[k // 27]} ==\n".replace("== ", "==").replace(" ==", "=="))
        out.append(f"==={'頭'}{k}===\n{chr(catalogs.FIRST_GLYPH + k)} {{{{!|首|x}}}}{k}\n")
        for z in range(9):
            label = "初一" if z == 0 else "次九" if z == 8 and k == 8 else "上九" if z == 8 else "次" + "二三四五六七八"[z - 1]
            mark = "" if at % 20 == 0 else "側曰：" if k == 2 else "測曰："
            out.append(f"{label}：贊{k}-{z}\n{mark}解{k}-{z}\n")
            at += 1
    return "".join(out) + "==太玄傳==\n傳\n{{footer}}\n初一：無"


def _heads(spark):
    return catalogs.ternary_heads(values(spark, "source string, raw string", [("t", heads())]))


@query("R17_ternary_heads")
def ternary_heads(spark, sf_dir):
    return _heads(spark).select("source", "ordinal", "name", "region", "glyph", "statement", F.size("zans").alias("zans"), "issue")


@query("R17_ternary_places")
def ternary_places(spark, sf_dir):
    return catalogs.ternary_places(_heads(spark)).withColumn("anomalies", F.array_join("anomalies", ","))


_TRIPLES = [("丙", "丁", "帛"), ("戊", "己", "玉"), ("庚", "辛", "简")]
_KINDS = list(_FORMS)
_TEXTS = [(f"{a}{r}{k}", form.format(a=a, r=r, t=t)) for x, y, t in _TRIPLES for a, r in ((x, y), (y, x)) for k, form in enumerate(_FORMS.values())]
_PAIRS = [(f"{x}{y}{i}", f"{x}{y}{(i + 1) % 3}", "paraphrase") for x, y, _ in _TRIPLES for i in range(3)] + [(f"{x}{y}{i}", f"{y}{x}{i}", "reversal") for x, y, _ in _TRIPLES for i in range(3)]


@query("V4_calibration", f"SELECT a, b, kind, CASE kind WHEN 'paraphrase' THEN 'SameRelation' ELSE 'RoleReversal' END AS learned, 'Unknown' AS empty FROM {values_sql(['a', 'b', 'kind'], _PAIRS)}")
def calibration(spark, sf_dir):
    """Nine paraphrases, nine reversals, and the same eighteen pairs as controls of a learner without fuel."""
    texts, pairs = values(spark, "id string, text string", _TEXTS), values(spark, "a string, b string, kind string", _PAIRS)
    for name, fuel in (("learned", 18), ("empty", 0)):
        read = relations.read(texts, relations.learned_state(_training(spark), fuel=fuel)).select("id", "roles")
        of = lambda end: read.select(F.col("id").alias(end), F.col("roles").alias(f"_{end}"))  # noqa: B023, E731
        pairs = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").withColumn(name, relations.compared(F.col("_a"), F.col("_b"))).drop("_a", "_b")
    return pairs
