"""Ordered chapter lists of works from a table of pages (title, content): links of a main page, of lists, of a table of contents, prefixes, containers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A link, a heading, a list's line, other name spaces, headings of contents, a chapter's heading, a page taken in.
LINK = r"\[\[([^\]|#]+)(?:#[^\]|]*)?(?:\|([^\]]*))?\]\]"
HEADING = r"^={2,4}\s*([^=]+?)\s*={2,4}\s*$"
ITEM = r"^\s*[#*]"
SPACES = "(?i)^(Portal|Category|分類|作者|wikipedia|s|w):"
CONTENTS = "目[錄录次]"
CHAPTER = r"^==\s*([^=][\s\S]*?)\s*==\s*$"
TAKEN_IN = r"\{\{\s*:\s*([^|}\n]+?)\s*\}\}"


def page_links(pages: DataFrame) -> DataFrame:
    """Links in order: title, line, place, item (the line is of a list), heading (the last one before), target, label (empty without one)."""
    lines = pages.select("title", F.posexplode(F.split("content", "\n")).alias("line", "text"))
    own = F.regexp_extract("text", HEADING, 1)
    before = Window.partitionBy("title").orderBy("line")  # a page's lines
    lines = lines.withColumn("heading", F.last(F.when(own != "", own), ignorenulls=True).over(before)).where(own == "")
    found = F.arrays_zip(F.regexp_extract_all("text", F.lit(LINK), 1).alias("target"), F.regexp_extract_all("text", F.lit(LINK), 2).alias("label"))
    rows = lines.select("title", "line", F.col("text").rlike(ITEM).alias("item"), "heading", F.posexplode(found).alias("place", "l"))
    return rows.select("title", "line", "place", "item", "heading", F.trim("l.target").alias("target"), F.col("l.label").alias("label"))


def _absolute(base: Column) -> Column:
    t = F.col("target")
    return F.when(F.startswith(t, F.lit("../")), F.concat(base, F.lit("/"), F.substr(t, F.lit(4)))).when(F.startswith(t, F.lit("/")), F.concat(base, t)).otherwise(t)


def _first(rows: DataFrame, *keep: str) -> DataFrame:
    """Of each page's links to a target the first."""
    first = F.min(F.struct("line", "place", *keep)).alias("f")
    return rows.groupBy("title", "target").agg(first).select("title", "target", "f.*")


def _chapters(rows: DataFrame, name: Column) -> DataFrame:
    """Chapters in order of the page: title, ord, chapter, page."""
    order = Window.partitionBy("title").orderBy("line", "place")
    return rows.select("title", (F.row_number().over(order) - 1).alias("ord"), name.alias("chapter"), F.col("target").alias("page"))


def _allowed(rows: DataFrame, exclude: str | None) -> DataFrame:
    return rows.where(~F.col("target").rlike(exclude)) if exclude else rows


def main_page_links(pages: DataFrame, exclude: str | None = None) -> DataFrame:
    """Links to pages below a main page, relative ones too, each once."""
    prefix = F.concat("title", F.lit("/"))
    rows = page_links(pages).withColumn("target", _absolute(F.col("title"))).where(F.startswith("target", prefix))
    return _chapters(_first(_allowed(rows, exclude)), F.substr("target", F.length(prefix) + 1))


def list_links(pages: DataFrame, known: DataFrame, exclude: str | None = None) -> DataFrame:
    """Links that lists of a page hold and that known (title) has; a target met first outside a list is none of it, nor one of another name space."""
    rows = page_links(pages).withColumn("target", _absolute(F.col("title"))).where(~F.contains("target", F.lit(":")))
    rows = _allowed(_first(rows, "item").where("item"), exclude)
    return _chapters(rows.join(known.select(F.col("title").alias("target")).distinct(), "target", "left_semi"), F.col("target"))


def toc_links(pages: DataFrame, heading: str = CONTENTS) -> DataFrame:
    """Links under headings that name a table of contents; the label is the chapter's name."""
    rows = page_links(pages).where(F.col("heading").rlike(heading) & ~F.col("target").rlike(SPACES))
    return _chapters(_first(rows, "label"), F.trim(F.when(F.col("label") != "", F.col("label")).otherwise(F.col("target"))))


def by_prefix(pages: DataFrame, prefix: str, prefer: str | None = None, exclude: str | None = None) -> DataFrame:
    """Pages below prefix; only the preferred ones where there are any."""
    rows = pages.where(F.startswith("title", F.lit(prefix))).select(F.col("title").alias("target"))
    if prefer:
        rows = rows.withColumn("_preferred", F.col("target").rlike(prefer))
        some = rows.agg(F.coalesce(F.bool_or("_preferred"), F.lit(False)).alias("_some"))
        rows = rows.crossJoin(some).where("_preferred or not _some").select("target")  # one row
    return _allowed(rows, exclude).select(F.substr("target", F.lit(len(prefix) + 1)).alias("chapter"), F.col("target").alias("page"))


def single(pages: DataFrame, title: str) -> DataFrame:
    return pages.where(F.col("title") == title).select(F.col("title").alias("chapter"), F.col("title").alias("page"))


def container_chain(containers: DataFrame, work: str, exclude: str | None = None) -> DataFrame:
    """Pages that containers (ord, title, content) take in, in order: container, line, chapter (the heading since the last page taken in, or the page's name below work), page.

    A page taken in again is passed over, and leaves the heading to the next.
    """
    lines = containers.select("ord", F.col("title").alias("container"), F.posexplode(F.split("content", "\n")).alias("line", "text"))
    heading = F.regexp_extract("text", CHAPTER, 1)
    page = F.trim(F.regexp_extract("text", TAKEN_IN, 1))
    lines = lines.select("ord", "container", "line", heading.alias("heading"), F.when(heading == "", page).otherwise("").alias("target"))
    taken = _allowed(lines.where("target <> ''"), exclude)
    taken = taken.groupBy("target").agg(F.min(F.struct("ord", "line", "container")).alias("f")).select("f.ord", "f.container", "f.line", F.lit("").alias("heading"), "target")
    rows = lines.where("heading <> ''").unionByName(taken)
    before = Window.partitionBy("ord").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)  # a container's lines
    met = F.struct("heading", "target")
    rows = rows.withColumn("met", F.last(met).over(before))
    name = F.when(F.col("met.heading") != "", F.col("met.heading")).otherwise(F.substr("target", F.lit(len(work) + 2)))
    return rows.where("target <> ''").select("ord", "container", "line", name.alias("chapter"), F.col("target").alias("page"))
