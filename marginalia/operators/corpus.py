"""Passages of hierarchical works, cleaning of markup, segmentation, and corpus checks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORK = (
    "schema string, id string, title struct<zh:string,en:string>, tradition string, "
    "counts struct<sections:int,passages:int,characters:int>, "
    "sections array<struct<id:string,ordinal:int,title:string,sourcePage:string,sourceRevid:bigint,"
    "passages:array<struct<id:string,sourceAnchor:string,text:string>>>>"
)


def read_works(spark: SparkSession, path: str) -> DataFrame:
    """Work documents (JSON, one each file); malformed ones have a null id and their text in _corrupt_record."""
    return spark.read.schema(WORK + ", _corrupt_record string").option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def passages(works: DataFrame) -> DataFrame:
    """One row per passage, with the places of section and passage."""
    s = works.select(F.col("id").alias("work_id"), F.posexplode("sections").alias("section_ord", "s"))
    p = s.select("work_id", F.col("s.id").alias("section_id"), "section_ord", F.col("s.sourcePage").alias("source_page"), F.col("s.sourceRevid").alias("source_revid"), F.posexplode("s.passages").alias("passage_ord", "p"))
    return p.select("work_id", "section_id", "section_ord", F.col("p.id").alias("passage_id"), "passage_ord", "source_page", "source_revid", F.col("p.text").alias("text"))


def manifest_gaps(declared: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Keys on one side only: unmanifested (present, not declared) and stale (declared, not present)."""
    a = present.select(key).distinct().join(declared.select(key), key, "left_anti").withColumn("gap", F.lit("unmanifested"))
    b = declared.select(key).distinct().join(present.select(key), key, "left_anti").withColumn("gap", F.lit("stale"))
    return a.union(b)


def merged_manifest(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """A partial rebuild: new entries replace old ones of their key, the others stay."""
    kept = old.join(new.select(key), key, "left_anti")
    return kept.unionByName(new)


# Cleaning steps over a text column; their order in clean_html and clean_wikitext is semantics.


def strip_comments(t: Column) -> Column:
    return F.regexp_replace(t, "(?s)<!--.*?-->", "")


def only_included(t: Column) -> Column:
    inner = F.regexp_extract(t, "(?s)<onlyinclude>(.*?)</onlyinclude>", 1)
    return F.when(inner != "", inner).otherwise(t)


def strip_tags(t: Column) -> Column:
    """References go with their content, line breaks become newlines, other tags are unwrapped."""
    t = F.regexp_replace(t, "(?is)<ref[^>]*/>", "")
    t = F.regexp_replace(t, "(?is)<(ref|script|style)\\b[^>]*>.*?</(ref|script|style)>", "")
    t = F.regexp_replace(t, "(?i)<br */?>|</p>|</div>|</li>|</h[1-6]>", "\n")
    return F.regexp_replace(t, "<[^>]*>", "")


def strip_links(t: Column) -> Column:
    t = F.regexp_replace(t, "(?i)\\[\\[(?:file|category|image):[^\\]]*\\]\\]", "")
    t = F.regexp_replace(t, "\\[\\[[^\\]|]*\\|([^\\]]*)\\]\\]", "$1")
    t = F.regexp_replace(t, "\\[\\[(?:[^\\]:]*:)?([^\\]]*)\\]\\]", "$1")
    return F.regexp_replace(t, "\\[https?://[^\\s\\]]+\\s?([^\\]]*)\\]", "$1")


# Named entities that texts use.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&amp;": "&"}


def decode_entities(t: Column) -> Column:
    for entity, char in ENTITIES.items():
        t = F.replace(t, F.lit(entity), F.lit(char))
    return t


def strip_switches(t: Column) -> Column:
    return F.regexp_replace(t, "__[A-Z]+__", "")


# Templates that wrap text of the work (their first parameter stays), and those that hold commentary.
CONTENT_TEMPLATES = ["另", "另2", "參", "参", "!", "僻字", "ProperNoun", "+", "-", "ruby", "專", "書", "標", "YL", "ul", "WavyBookMark", "別", "校", "quote", "blue", "red", "~~", "PUA", "？"]
COMMENTARY_TEMPLATES = ["green", "deepPink", "annotate", "註", "註釋"]


def _quoted(names: list[str]) -> str:
    return "|".join(re.escape(n) for n in names)


def repeated(t: Column, mark: str, step, most: int | None = None) -> Column:
    """step applied to t once for each occurrence of mark in it (at most most times): enough for any nesting, from the inside."""
    times = F.regexp_count(t, F.lit(mark))
    times = F.least(times, F.lit(most)) if most else times
    return F.when(times > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(times, F.lit(1))), t, lambda s, _: step(s))).otherwise(t)


def strip_templates(t: Column, kept: list[str] = CONTENT_TEMPLATES) -> Column:
    """Templates, innermost first, however deep: of those in kept the first parameter stays, others go whole. Unbalanced braces eat no text."""
    inner = r"(?:(?!\{\{|\}\})[\s\S])*"
    first = r"\{\{\s*(?:" + _quoted(kept) + r")\s*\|((?:\[\[[^\]]*\]\]|(?!\{\{|\}\}|\|)[\s\S])*)(?:\|" + inner + r")?\}\}"
    return repeated(t, r"\{\{", lambda s: F.regexp_replace(F.regexp_replace(s, first, "$1"), r"\{\{\s*(?!(?:" + _quoted(kept) + r")\s*\|)" + inner + r"\}\}", ""))


def template_counts(t: Column) -> Column:
    """Templates that keep text, commentary templates, and all."""
    n = lambda names: F.regexp_count(t, F.lit(r"\{\{\s*(?:" + _quoted(names) + r")\s*\|"))
    return F.struct(n(CONTENT_TEMPLATES).alias("content"), n(COMMENTARY_TEMPLATES).alias("commentary"), F.regexp_count(t, F.lit(r"\{\{")).alias("all"))


def strip_conversions(t: Column, passes: int = 20) -> Column:
    """Language-conversion markers -{x}-, innermost first: flags go, of variants the last form stays."""
    inner = r"(?:(?!-\{|\}-)[\s\S])*"

    def step(s: Column) -> Column:
        s = F.regexp_replace(s, r"-\{\s*[A-Za-z]\s*\|" + inner + r"\}-", "")
        s = F.regexp_replace(s, r"-\{" + inner + r"\|((?:(?!-\{|\}-|\|)[\s\S])*?)\s*\}-", "$1")
        s = F.regexp_replace(s, r"-\{(?:(?!-\{|\}-|\|)[\s\S])*:((?:(?!-\{|\}-|\||:)[\s\S])*?)\s*\}-", "$1")
        return F.regexp_replace(s, r"-\{\s*((?:(?!-\{|\}-|\||:)[\s\S])*?)\s*\}-", "$1")

    return repeated(t, r"-\{", step, passes)


def decode_numeric(t: Column) -> Column:
    """&#N; as the letter of that number; numbers of no letter stay."""
    letter = lambda n: F.decode(F.unhex(F.lpad(F.hex(n.cast("long")), 8, "0")), "UTF-32")
    codes = F.filter(F.array_distinct(F.regexp_extract_all(t, F.lit(r"&#(\d{1,7});"), 1)), lambda n: (n.cast("long") <= 0x10FFFF) & ~n.cast("long").between(0xD800, 0xDFFF))
    return F.aggregate(codes, t, lambda s, n: F.replace(s, F.concat(F.lit("&#"), n, F.lit(";")), letter(n)))


def lift_anchors(t: Column) -> Column:
    """<div id="x"> (with its own bold name as content, if so) becomes a line with the marker NUL A:x NUL."""
    t = F.regexp_replace(t, "<div[^>]*\\bid=\"([^\"]+)\"[^>]*>\\s*'{2,3}\\s*\\1\\s*'{2,3}\\s*</div>", "\n\u0000A:$1\u0000\n")
    return F.regexp_replace(t, "<div[^>]*\\bid=\"([^\"]+)\"[^>]*>", "\n\u0000A:$1\u0000\n")


def strip_annotations(t: Column) -> Column:
    """Regions {{*s}} to {{*e}} go with what they hold."""
    return F.regexp_replace(t, r"\{\{\s*\*s\s*\}\}[\s\S]*?\{\{\s*\*e\s*\}\}", "")


def drop_elements(t: Column, tags: list[str]) -> Column:
    """Elements of the declared names go with what they hold."""
    for tag in tags:
        t = F.regexp_replace(F.regexp_replace(t, rf"(?i)<{tag}\b[^>]*>[\s\S]*?</{tag}>", ""), rf"(?i)<{tag}\b[^>]*/>", "")
    return t


def demote_headings(t: Column, least: int = 2, most: int = 4) -> Column:
    """Headings of other levels than least to most become plain lines."""

    def line(x: Column) -> Column:
        rx = r"^(={1,6})\s*([^=\n].*?)\s*\1$"
        level = F.length(F.regexp_extract(F.trim(x), rx, 1))
        return F.when((level > 0) & ~level.between(least, most), F.trim(F.regexp_extract(F.trim(x), rx, 2))).otherwise(x)

    return F.array_join(F.transform(F.split(t, "\n"), line), "\n")


def drop_sections(rows: DataFrame, title: str, titles: list[str]) -> DataFrame:
    """Sections but those of the given titles."""
    return rows.where(F.col(title).isNull() | ~F.trim(F.col(title)).isin(titles))


def clean_inline(t: Column) -> Column:
    """A title on one line: every markup step but those for lines and sections, quote marks and runs of white space."""
    t = strip_conversions(strip_links(strip_tags(strip_templates(strip_comments(F.coalesce(t, F.lit("")))))))
    t = decode_entities(decode_numeric(t))
    return F.trim(F.regexp_replace(F.regexp_replace(t, "'{2,3}", ""), r"[\s ]+", " "))


def normalize_lines(t: Column) -> Column:
    lines = F.transform(F.split(F.regexp_replace(t, "\\r\\n?", "\n"), "\n"), lambda x: F.regexp_replace(F.regexp_replace(x, "^[:;*#]+", ""), "^[ \\t]+|[ \\t]+$", ""))
    return F.regexp_replace(F.regexp_replace(F.array_join(lines, "\n"), "\n{3,}", "\n\n"), "^\n+|\n+$", "")


def drop_lines(t: Column, pattern: str) -> Column:
    return F.array_join(F.filter(F.split(t, "\n"), lambda x: ~x.rlike(pattern)), "\n")


def clean_html(t: Column) -> Column:
    return normalize_lines(decode_entities(strip_tags(strip_comments(t))))


def clean_wikitext(t: Column) -> Column:
    t = strip_templates(strip_annotations(only_included(strip_comments(t))))
    return normalize_lines(strip_switches(decode_entities(decode_numeric(strip_conversions(strip_links(strip_tags(t)))))))


def sections(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Sections at headings == title ==: key, section, title (null before the first heading), body."""
    rx = "(?m)^={2,4}[^=\n]+={2,4}[ \\t]*$"
    marks = F.regexp_extract_all(text, F.lit(rx), 0)
    bodies = F.split(text, rx, -1)
    rows = docs.select(key, F.posexplode(F.arrays_zip(F.concat(F.array(F.lit(None).cast("string")), marks).alias("title"), bodies.alias("body"))).alias("section", "s"))
    return rows.select(key, "section", F.trim(F.translate("s.title", "=", "")).alias("title"), F.col("s.body").alias("body"))


def split_passages(docs: DataFrame, key: str, text: str, separator: str = "\n\\s*\n") -> DataFrame:
    """Passages at blank lines: key, passage, text; empty ones go, places count what stays."""
    parts = F.filter(F.transform(F.split(text, separator), lambda x: F.trim(x)), lambda x: x != "")
    return docs.select(key, F.posexplode(parts).alias("passage", "text"))


def carried_forward(rows: DataFrame, value: str, partition: str, order: str) -> DataFrame:
    """value, or the last one before it in its partition."""
    w = Window.partitionBy(partition).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(value, F.last(value, ignorenulls=True).over(w))


# What marks a passage as no text of the work, in this order; the second holds for up to four letters.
COLOPHON, NUMBERED, AFTER, HEADING = r"^右[^\n]{0,8}$", r"^[^\n]{1,4}[一二三四五六七八九十]$", r"^[一二三四五六七八九十]+。", r"^[^\n]{2,4}$"
# Markup that must not be left in a text, in the order of report.
RESIDUE = {
    "template braces": r"\{\{|\}\}",
    "wiki link brackets": r"\[\[|\]\]",
    "html tag": r"</?[a-zA-Z][^>]*>",
    "behaviour switch": r"__NOTOC__|__NOEDITSECTION__",
    "language conversion marker": r"-\{|\}-",
    "internal anchor marker": r"\x00",
    "html entity": r"&(?:nbsp|amp|lt|gt|quot);",
    "comment marker": r"<!--|-->",
}


def structural(rows: DataFrame, text: str, partition: str, order: list[str]) -> DataFrame:
    """rows with marker, the first rule that fits: right-colophon, numbered-heading, heading-after-numbered; null for text. By form, never by length alone."""
    before = F.lag(text).over(Window.partitionBy(partition).orderBy(*order))
    t = F.col(text)
    after = F.coalesce(before.rlike(AFTER), F.lit(False)) & t.rlike(HEADING)
    marker = F.when(t.rlike(COLOPHON), "right-colophon").when((F.length(t) <= 4) & t.rlike(NUMBERED), "numbered-heading").when(after, "heading-after-numbered")
    return rows.withColumn("marker", marker)


def residue(text: Column, rules: dict[str, str]) -> Column:
    """Name of the first rule whose pattern is in text."""
    out = F.lit(None).cast("string")
    for name, rx in reversed(rules.items()):
        out = F.when(text.rlike(rx), name).otherwise(out)
    return out
