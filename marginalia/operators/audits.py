"""Scans without manifest, pinned snapshots, headers of pages, audits of held-out records, receipts and reports."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import u16len
from . import relations


def scanned(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Rows of the *.json files under folder, whatever else lies there, with the file each came from."""
    return spark.read.schema(schema).option("pathGlobFilter", "*.json").option("recursiveFileLookup", True).json(folder).select("*", F.col("_metadata.file_path").alias("file"))


def within_units(rows: DataFrame, text: str, most: int = 2048) -> DataFrame:
    """Rows whose text has at most so many UTF-16 units; null texts go."""
    return rows.where(u16len(F.col(text)) <= most)


def pinned(snapshots: DataFrame, pins: DataFrame, key: str, body: str, revision: str) -> DataFrame:
    """Per pin (key, sha256, revision): pinned, digest-mismatch, revision-mismatch, or missing without a snapshot."""
    have = snapshots.select(key, F.sha2(F.col(body), 256).alias("_digest"), F.col(revision).alias("_revision"), F.lit(True).alias("_there"))
    status = F.when(F.col("_there").isNull(), "missing").when(~F.col("sha256").eqNullSafe(F.col("_digest")), "digest-mismatch").when(~F.col(revision).eqNullSafe(F.col("_revision")), "revision-mismatch").otherwise("pinned")
    return pins.join(have, key, "left").select(key, status.alias("status"))


# The content template, markup that is not read, a page taken in, what a page's own text is less, a header.
CONTENT, MARKUP = r"\{\{!\|([^|{}]+)\|[^{}]*\}\}", r"[{}]|\[\[|\]\]|</?\w"
TAKEN_IN = r"\{\{\s*:\s*([^|}\n]+?)\s*\}\}"
NOT_OWN = [r"\{\{[\s\S]*?\}\}", r"<!--[\s\S]*?-->", "<[^>]+>"]
HEADER = r"(?is)\{\{(\s*[A-Za-z0-9_. ]*header[A-Za-z0-9_. ]*\s*(?:\||\}\}).*)"


def rendered(raw: Column) -> Column:
    """Text with the one known content template read; null where any other markup is left."""
    text = F.regexp_replace(raw, CONTENT, "$1")
    return F.when(~text.rlike(MARKUP), text)


def transclusions(text: Column) -> Column:
    """Names of pages that a page takes in whole."""
    return F.transform(F.regexp_extract_all(text, F.lit(TAKEN_IN), 1), lambda x: F.trim(x))


def is_container(text: Column, least: int = 200) -> Column:
    """Whether a page takes in others and has under least units of its own text."""
    own = text
    for rx in NOT_OWN:
        own = F.regexp_replace(own, rx, "")
    return (F.size(transclusions(text)) > 0) & (u16len(F.trim(own)) < least)


def unit_of(page: Column) -> Column:
    """The last part of a page's path, without what stands in brackets at its end."""
    return F.regexp_replace(F.substring_index(page, "/", -1), r"\s*[（(][^）)]*[）)]\s*$", "")


def link_target(value: Column, page: Column) -> Column:
    """The page that the first link of value names; ../ stands for the parent of page. Null without a link."""
    name = F.trim(F.regexp_extract(value, r"\[\[([^\]|#]+)(?:#[^\]|]*)?(?:\|[^\]]*)?\]\]", 1))
    parent = F.when(F.contains(page, F.lit("/")), F.regexp_extract(page, "^(.*/)", 1)).otherwise("")
    return F.when(name != "", F.when(F.startswith(name, F.lit("../")), F.concat(parent, F.substr(name, F.lit(4)))).otherwise(name))


def _joined_while_open(pieces: Column, separator: str, opened) -> Column:
    """Pieces joined again where the separator stood inside something opened and not yet closed; opened(piece) is what it opens less what it closes."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("part"), F.lit(0).alias("depth"))

    def step(s: Column, p: Column) -> Column:
        part = F.when(s["part"].isNull(), p).otherwise(F.concat(s["part"], F.lit(separator), p))
        depth = s["depth"] + opened(p)
        ends = depth <= 0
        return F.struct(F.when(ends, F.concat(s["done"], F.array(part))).otherwise(s["done"]).alias("done"), F.when(~ends, part).alias("part"), F.when(ends, 0).otherwise(depth).alias("depth"))

    return F.aggregate(pieces, start, step, lambda s: F.when(s["part"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(s["part"]))))


def header_fields(text: Column) -> Column:
    """(key, value) of the fields of the first template whose name holds "header", keys in lower case, the last of a key; empty without one or without its end."""
    rest = F.regexp_extract(text, HEADER, 1)
    n = lambda p, rx: F.regexp_count(p, F.lit(rx))
    closes = F.split(rest, r"\}\}")
    # the piece before each }} with what it opens: the header ends at the first }} that closes more than was opened inside
    start = F.struct(F.lit(None).cast("string").alias("body"), F.lit("").alias("read"), F.lit(0).alias("open"))

    def step(s: Column, p: Column) -> Column:
        opened = s["open"] + n(p, r"\{\{")
        read = F.concat(s["read"], p)
        return F.struct(F.when(s["body"].isNotNull(), s["body"]).when(opened == 0, read).alias("body"), F.concat(read, F.lit("}}")).alias("read"), (opened - 1).alias("open"))

    body = F.aggregate(F.slice(closes, 1, F.greatest(F.size(closes) - 1, F.lit(0))), start, step, lambda s: s["body"])
    parts = _joined_while_open(F.split(F.coalesce(body, F.lit("")), r"\|"), "|", lambda p: n(p, r"\{\{|\[\[") - n(p, r"\}\}|\]\]"))
    pairs = F.transform(F.filter(parts, lambda p: F.instr(p, "=") > 1), lambda p: F.struct(F.lower(F.trim(F.regexp_extract(p, r"(?s)^([^=]*)=", 1))).alias("key"), F.regexp_replace(F.regexp_extract(p, r"(?s)^[^=]*=(.*)$", 1), r"^\s+|\s+$", "").alias("value")))
    pairs = F.transform(pairs, lambda x: F.struct(F.regexp_replace(x["key"], r"^\s+|\s+$", "").alias("key"), x["value"].alias("value")))
    last = F.filter(pairs, lambda x, i: (x["key"] != "") & ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda y: y["key"] == x["key"]))
    return F.coalesce(last, F.array().cast("array<struct<key:string,value:string>>"))


def held_out_audit(held: DataFrame, state: DataFrame) -> DataFrame:
    """Held-out records (id, text, roles) that some construction reads: clean, or whether no order of roles that the core's state leaves gives theirs.

    A record contradicts the core alone or not at all, since orders are only ever refuted: no batches are needed.
    """
    read = relations.parsed(held).where("construction is not null")
    tried = read.join(F.broadcast(state), "construction", "left")  # six orders for each construction at most
    agrees = F.coalesce(relations.assigned(F.col("slots"), F.col("roles_order")) == F.col("roles"), F.lit(False))
    return tried.groupBy("id", "construction").agg(F.max(agrees).alias("clean"))


def projected(records: DataFrame, grammar: str, order: str, cap: int) -> tuple[DataFrame, DataFrame]:
    """(pools, chosen): per grammar its size, how many records a cap would drop and whether it is refused for that; and the first cap records by order, which only who accepts a cut may use.

    The ranks stop at cap in each task before the shuffle, so a large grammar is not sorted in one.
    """
    from pyspark.sql import Window

    pools = records.groupBy(grammar).agg(F.count("*").alias("pool"))
    pools = pools.withColumn("dropped", F.greatest(F.col("pool") - cap, F.lit(0))).withColumn("refused", F.col("pool") > cap)
    chosen = records.withColumn("place", F.row_number().over(Window.partitionBy(grammar).orderBy(order))).where(F.col("place") <= cap)
    return pools, chosen


def open_questions(candidates: DataFrame, ruled: DataFrame, keys: list[str], n: str) -> DataFrame:
    """Candidates that nobody has ruled on, the most frequent first; ties by keys."""
    return candidates.join(ruled.select(*keys).distinct(), keys, "left_anti").orderBy(F.desc(n), *keys)


def reopened(judgements: DataFrame, withdrawn: DataFrame, claim: str, verdict: str, order: str, name: str) -> DataFrame:
    """Claims whose answer was open again: since when (order of the first judgement of the other side), and the state once withdrawn judgements are gone.

    Two aggregations, whatever the order of arrival; a late row changes what a later run says of its claim alone.
    """
    side = judgements.groupBy(claim, verdict).agg(F.min(order).alias("first"))
    since = side.groupBy(claim).agg(F.count("*").alias("sides"), F.max("first").alias("since")).where("sides > 1").drop("sides")
    left = judgements.join(withdrawn.select(name).distinct(), name, "left_anti").groupBy(claim).agg(F.count_distinct(verdict).alias("left"))
    state = F.when(F.col("left") > 1, "Contested").when(F.col("left") == 1, "Answered").otherwise("Unknown")
    return since.join(left, claim, "left").select(claim, "since", state.alias("state"))


def content_audit(works: DataFrame, fixtures: DataFrame, work: str, text: str) -> DataFrame:
    """Per fixture (work, needle, wanted): whether some text of the work holds needle, and whether that is as wanted. fixtures are declared, so few."""
    # the fixtures go to the texts, so no text is shuffled; each task sends a row for each fixture
    there = works.select(work, text).join(F.broadcast(fixtures), work).groupBy(work, "needle", "wanted").agg(F.bool_or(F.contains(F.col(text), F.col("needle"))).alias("_there"))
    same = [F.col(f"f.{c}").eqNullSafe(F.col(f"t.{c}")) for c in (work, "needle", "wanted")]
    hit = fixtures.distinct().alias("f").join(F.broadcast(there).alias("t"), reduce(and_, same), "left").select("f.*", F.coalesce("t._there", F.lit(False)).alias("found"))
    return hit.withColumn("ok", F.col("found") == F.col("wanted"))


def cohort_checks(cohort: DataFrame, known: DataFrame, key: str, text: str, count: int | None = None) -> DataFrame:
    """Checks of a sealed cohort against what is known: ids are unique, texts are unique, no text is known, the count is as declared."""
    fresh = cohort.select(text).distinct().join(known.select(text), text, "left_semi").agg(F.count("*").alias("known"))
    sizes = cohort.agg(F.count("*").alias("n"), F.count_distinct(key).alias("ids"), F.count_distinct(text).alias("texts"))
    rows = sizes.crossJoin(fresh)  # one row each
    checks = [("unique ids", F.col("ids") == F.col("n")), ("unique texts", F.col("texts") == F.col("n")), ("fresh texts", F.col("known") == 0)]
    if count is not None:
        checks.append(("declared count", F.col("n") == count))
    return rows.select(F.explode(F.array(*[F.struct(F.lit(name).alias("check"), ok.alias("ok")) for name, ok in checks])).alias("c")).select("c.*")


def blob_id(text: Column) -> Column:
    """The id that git gives a file of this text."""
    body = F.encode(text, "UTF-8")
    return F.sha1(F.concat(F.encode(F.concat(F.lit("blob "), F.octet_length(body).cast("string"), F.lit("\0")), "UTF-8"), body))


def sequence_checks(steps: DataFrame, of: str, place: str, name: str, cycle: list[str]) -> DataFrame:
    """Per group: whether its places are 0, 1, ... without gap or repeat, and its names go through cycle in order. Aggregates only, so a group may be of any size."""
    wanted = F.get(F.array(*map(F.lit, cycle)), F.col(place) % len(cycle))
    n = F.count("*")
    gapless = (F.min(place) == 0) & (F.max(place) == n - 1) & (F.count_distinct(place) == n)
    return steps.groupBy(of).agg(gapless.alias("gapless"), F.coalesce(F.bool_and(F.col(name).eqNullSafe(wanted)), F.lit(False)).alias("in_order"))


def record_pairs(records: DataFrame, key: str, roles: str) -> DataFrame:
    """All ordered pairs of different records with their comparison; for declared records, whose number is small."""
    a = records.select(F.col(key).alias("a"), F.col(roles).alias("_a"))
    b = records.select(F.col(key).alias("b"), F.col(roles).alias("_b"))
    return a.join(F.broadcast(b), F.col("a") != F.col("b")).select("a", "b", relations.compared(F.col("_a"), F.col("_b")).alias("relation"))


def report(rows: DataFrame, folder: str, write: bool = False) -> bool:
    """Whether the report under folder holds these rows already; with write, it is replaced if not. An absent report is another one."""
    spark = rows.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    old = spark.read.schema(rows.schema).parquet(folder) if there else None
    same = old is not None and rows.exceptAll(old).isEmpty() and old.exceptAll(rows).isEmpty()
    if write and not same:
        rows.write.mode("overwrite").parquet(folder)
    return same
