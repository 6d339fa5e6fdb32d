"""Corpus analytics: density by group, n-grams, co-occurrence, scores, ladders, samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import grams, half_up, share
from ..sources.tables import freed, written

#: Buckets that grams are counted in, and how many of the fullest are looked into first.
BUCKETS, FULLEST = 1 << 18, 2048


def density(rows: DataFrame, work: str, hit: Column) -> DataFrame:
    """Per work: passages, readable, density."""
    out = rows.groupBy(work).agg(F.count("*").alias("passages"), F.count_if(hit).alias("readable"))
    return out.withColumn("density", share(F.col("readable"), F.col("passages"), 4))


def group_stats(per_work: DataFrame, group: str) -> DataFrame:
    """Per group of works: pooled rate, exact median, least and greatest density."""
    return per_work.groupBy(group).agg(
        F.count("*").alias("works"),
        F.sum("passages").alias("passages"),
        F.sum("readable").alias("readable"),
        share(F.sum("readable"), F.sum("passages")).alias("pooled"),
        half_up(F.percentile("density", F.lit(0.5)), 4).alias("median"),
        F.min("density").alias("least"),
        F.max("density").alias("greatest"),
    )


def gram_counts(rows: DataFrame, key: str, words: Column, sizes: list[int], group: str, least: int, buckets: DataFrame | None = None) -> DataFrame:
    """n-grams by how many passages have them (once each), how many groups, and the least passage that has it. Counted by (gram, group) first, so a gram's groups need no second shuffle of all rows. buckets: only the grams of these."""
    each = _grams(rows, key, words, sizes, group)
    if buckets is not None:
        each = each.withColumn("bucket", _bucket()).join(F.broadcast(buckets.select("bucket")), "bucket", "left_semi")
    per_group = each.groupBy("gram", group).agg(F.count("*").alias("n"), F.min(key).alias("first"))
    return per_group.groupBy("gram").agg(F.sum("n").alias("passages"), F.count("*").alias("groups"), F.min("first").alias("witness")).where(F.col("passages") >= least)


def _grams(rows: DataFrame, key: str, words: Column, sizes: list[int], group: str) -> DataFrame:
    split = rows.select(key, group, words.alias("_w"))  # a column of its own, so that texts are split once
    return split.select(key, group, F.explode(F.array_distinct(F.flatten(F.array(*[grams(F.col("_w"), n) for n in sizes])))).alias("gram"))


def _bucket() -> Column:
    return F.pmod(F.xxhash64("gram"), F.lit(BUCKETS))


def top_grams(rows: DataFrame, key: str, words: Column, sizes: list[int], group: str, least: int, k: int) -> DataFrame:
    """The k first of gram_counts by passages, then gram; grams that can't be among them are not shuffled.

    A gram is in no more passages than all grams of its bucket together. The grams of the fullest
    buckets are counted first; if the last of k found does not stand above every other bucket, those
    of all buckets that reach it are counted. A task sends a row for each bucket at most.
    """
    full = written(_grams(rows, key, words, sizes, group).groupBy(_bucket().alias("bucket")).agg(F.count("*").alias("n")), "buckets")
    ranked = full.orderBy(F.desc("n")).limit(FULLEST + 1).select("n").collect()
    rest = ranked[-1]["n"] if len(ranked) > FULLEST else 0  # the most that a bucket left out has
    found = top(written(gram_counts(rows, key, words, sizes, group, least, full.where(F.col("n") > rest)), "grams"), k, "passages", "gram")
    seen = [r["passages"] for r in found.select("passages").collect()]
    floor = max(least, seen[-1] if len(seen) == k else 0)
    if rest < floor:
        return found
    freed(rows.sparkSession)
    return top(gram_counts(rows, key, words, sizes, group, floor, full.where(F.col("n") >= floor)), k, "passages", "gram")


def top(rows: DataFrame, k: int, by: str, tie: str) -> DataFrame:
    return rows.orderBy(F.desc(by), tie).limit(k)


def matrix(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Co-occurrence counts with each row's total, share and whether it is the row's largest (ties: the first b)."""
    counts = rows.groupBy(a, b).agg(F.count("*").alias("n"))
    of_row = Window.partitionBy(a)
    rank = F.row_number().over(of_row.orderBy(F.desc("n"), b))
    return counts.select(a, b, "n", F.sum("n").over(of_row).alias("row_total"), share(F.col("n"), F.sum("n").over(of_row)).alias("row_share"), (rank == 1).alias("is_top"))


def pattern_coverage(rows: DataFrame, text: str, patterns: dict[str, str]) -> DataFrame:
    """Per pattern: passages with it, occurrences; the row 'any' counts a passage once over all."""
    hits = {k: F.count_if(F.col(text).rlike(rx)).alias(f"{k}_p") for k, rx in patterns.items()}
    occ = {k: F.sum(F.regexp_count(text, F.lit(rx))).alias(f"{k}_o") for k, rx in patterns.items()}
    any_ = F.count_if(F.exists(F.array(*map(F.lit, patterns.values())), lambda rx: F.regexp_like(F.col(text), rx))).alias("any_p")
    one = rows.agg(*hits.values(), *occ.values(), any_)
    parts = [F.struct(F.lit(k).alias("pattern"), F.col(f"{k}_p").alias("passages"), F.col(f"{k}_o").alias("occurrences")) for k in patterns]
    parts.append(F.struct(F.lit("any").alias("pattern"), F.col("any_p").alias("passages"), F.lit(None).cast("bigint").alias("occurrences")))
    return one.select(F.explode(F.array(*parts)).alias("r")).select("r.*")


def scored(rows: DataFrame, truth: str, prediction: str) -> DataFrame:
    """Coverage, accuracy among answered (null if none) and false acceptance of a predictor that may abstain (null)."""
    answered, right = F.col(prediction).isNotNull(), F.col(prediction) == F.col(truth)
    return rows.agg(
        F.count("*").alias("total"),
        F.count_if(answered).alias("answered"),
        F.count_if(right).alias("correct"),
        share(F.count_if(answered), F.count("*")).alias("coverage"),
        share(F.count_if(right), F.count_if(answered)).alias("accuracy"),
        F.count_if(answered & ~right).alias("wrong"),
    )


def core(rows: DataFrame, group: str, order: list, limit: int) -> DataFrame:
    """The first limit rows of each group."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= limit)


def completed(counts: DataFrame, expected: DataFrame, key: str, value: str) -> DataFrame:
    """Expected keys and observed ones: what is absent counts 0, what was not expected is marked."""
    e = expected.select(key).withColumn("_e", F.lit(True))
    out = e.join(counts, key, "full_outer")
    return out.select(key, F.coalesce(value, F.lit(0)).alias(value), F.coalesce("_e", F.lit(False)).alias("expected"))


def stride(rows: DataFrame, order: str, step: int) -> DataFrame:
    """Every step-th row of the order, from the first, without one global sort.

    A row's place is the rows in lower ranges of order plus its place within its own range. Ranges
    are summed in two levels, so no task sees more than those of one upper range, or the upper ones.
    """
    spans = rows.withColumn("_range", F.floor(F.col(order) / 4096)).withColumn("_upper", F.floor(F.col("_range") / 4096))
    before = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = spans.groupBy("_upper", "_range").agg(F.count("*").alias("_n"))
    uppers = sizes.groupBy("_upper").agg(F.sum("_n").alias("_n")).select("_upper", before(Window.orderBy("_upper")).alias("_lower"))
    sizes = sizes.withColumn("_before", before(Window.partitionBy("_upper").orderBy("_range"))).join(uppers, "_upper").select("_range", (F.col("_before") + F.col("_lower")).alias("_before"))
    place = F.col("_before") + F.row_number().over(Window.partitionBy("_range").orderBy(order)) - 1
    return spans.drop("_upper").join(sizes, "_range").withColumn("place", place).where(F.pmod("place", F.lit(step)) == 0).drop("_range", "_before")


def transitions(rows: DataFrame, partition: str, order: list[str], node: str) -> DataFrame:
    """Directed edges from each row's node to the next one's in its partition, distinct ends only."""
    nxt = F.lead(node).over(Window.partitionBy(partition).orderBy(*order))
    return rows.select(F.col(node).alias("a"), nxt.alias("b")).where("b is not null and a <> b")


def reciprocity(edges: DataFrame) -> DataFrame:
    """Distinct edges, those whose reverse is there, and the rate."""
    e = edges.select("a", "b").distinct()
    back = e.select(F.col("b").alias("a"), F.col("a").alias("b")).withColumn("_back", F.lit(1))
    return e.join(back, ["a", "b"], "left").agg(F.count("*").alias("edges"), F.count("_back").alias("reciprocal"), share(F.count("_back"), F.count("*")).alias("rate"))


def places(rows: DataFrame, keep: list[str], name: Column) -> DataFrame:
    """The columns keep of rows with r, the place of each row by the hash of name, in parts of the hash's range: no task sorts all rows.

    Only rows and the number of their part are shuffled; the hash is made again where it is sorted by.
    """
    h = F.sha2(name.cast("binary"), 256)
    part = F.conv(F.substring(h, 1, 3), 16, 10).cast("int")  # 4096 parts
    rows = rows.withColumn("_part", part)
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # 4096 rows at most
    sizes = sizes.select("_part", before.alias("_before"))
    dealt = rows.repartition("_part").withColumn("_h", F.unhex(h))
    return dealt.withColumn("_k", F.row_number().over(Window.partitionBy("_part").orderBy("_h"))).drop("_h").join(F.broadcast(sizes), "_part").select(*keep, (F.col("_before") + F.col("_k")).alias("r"))


def permutation_null(edges: DataFrame, trials: int, seed: str = "null") -> DataFrame:
    """Reciprocal edges when the second ends are shuffled: per trial, first ends by the order of a hash of the edge, second ends by one of trial, edge and seed.

    Trials run one after another and each frees its shuffle files, so disk does not grow with their
    number. The first ends' order is that of all trials and made once. Both directions of a pair
    of ends are counted in one aggregation.
    """
    spark = edges.sparkSession
    e = written(edges.select("a", "b").distinct(), "edges")
    first = written(places(e, ["a"], F.concat_ws("|", "a", "b")), "first-ends")
    found = []
    for trial in range(1, trials + 1):
        second = places(e, ["b"], F.concat_ws("|", F.lit(trial), "a", "b", F.lit(seed)))
        lo, hi = F.least("a", "b"), F.greatest("a", "b")
        ways = first.join(second, "r").groupBy(lo.alias("lo"), hi.alias("hi")).agg(F.max(F.col("a") <= F.col("b")).alias("up"), F.max(F.col("a") > F.col("b")).alias("down"))
        up, down = F.col("up").cast("long"), F.col("down").cast("long")
        # an edge to itself is its own reverse
        back = F.when(F.col("up") & F.col("down"), 2).when(F.col("lo") == F.col("hi"), 1).otherwise(0)
        found.append(written(ways.agg(F.lit(trial).alias("trial"), F.coalesce(F.sum(up + down), F.lit(0)).alias("edges"), F.coalesce(F.sum(back), F.lit(0)).alias("reciprocal")), "trial"))
        freed(spark)
    return reduce(DataFrame.union, found).where("edges > 0")
