"""A format validator: many rules in one pass over a table, and of each rule's violations a number and a few keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written


def broken(rows: DataFrame, key: Column, rules: dict[str, Column]) -> DataFrame:
    """rule, key: a row for every rule that a row breaks. Rules are conditions of good rows; null is not good."""
    marks = F.array(*[F.when(~F.coalesce(good, F.lit(False)), F.lit(rule)) for rule, good in rules.items()])
    return rows.select(F.coalesce(key.cast("string"), F.lit("")).alias("key"), F.explode(F.array_compact(marks)).alias("rule")).select("rule", "key")


def works(rows: DataFrame, work: str, ordinal: str) -> DataFrame:
    """Rows for works whose parts are numbered otherwise than from the first on, one by one; (rule, key) with rules ordinal-twice and ordinal-gap.

    Parts are counted by work and ordinal, then by work, so a work with most rows is added up within tasks.
    """
    each = rows.where(F.col(ordinal).isNotNull()).groupBy(work, ordinal).agg(F.count("*").alias("n"))
    per = each.groupBy(work).agg(F.max("n").alias("n"), F.count("*").alias("parts"), F.min(ordinal).alias("lo"), F.max(ordinal).alias("hi"))
    return broken(per, F.col(work), {"ordinal-twice": F.col("n") == 1, "ordinal-gap": F.col("hi") - F.col("lo") + 1 == F.col("parts")})


def repeated(rows: DataFrame, key: str, rule: str) -> DataFrame:
    """(rule, key) of keys that several rows have."""
    return broken(rows.groupBy(key).agg(F.count("*").alias("n")), F.col(key), {rule: F.col("n") == 1})


def report(parts: list[DataFrame], rules: list[str], keys: int = 3) -> DataFrame:
    """rule, violations, sample (the least keys, by |) for every declared rule, those that nothing breaks included.

    Spark ranks within each task before it shuffles, so of a rule that most rows break only a few
    keys of a task leave it.
    """
    found = written(reduce(DataFrame.union, parts), "violations")
    counts = found.groupBy("rule").agg(F.count("*").alias("violations"))
    least = found.withColumn("_k", F.row_number().over(Window.partitionBy("rule").orderBy("key"))).where(F.col("_k") <= keys)
    least = least.groupBy("rule").agg(F.array_sort(F.collect_list(F.struct("_k", "key"))).alias("x"))
    declared = found.sparkSession.createDataFrame([(r,) for r in rules], "rule string")
    out = declared.join(counts, "rule", "left").join(least, "rule", "left")
    return out.select("rule", F.coalesce("violations", F.lit(0)).alias("violations"), F.coalesce(F.concat_ws("|", F.transform("x", lambda x: x["key"])), F.lit("")).alias("sample"))
