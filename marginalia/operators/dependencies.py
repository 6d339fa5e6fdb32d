"""Declared conflations as functional dependencies, with three verdicts.

To declare that X must not be taken for Y is to say that rows alike in X need not be alike in Y; to
declare that X settles Y, that they are. Either is checked on the groups of rows alike in X. A group
of one row, or with one value that is not null, can show nothing: a dependency that no group puts to
the test is unchecked, null, neither true nor false. The lattice of sets X is walked from small to
large. Where no two rows are alike in X none are alike in a larger set, so larger sets need no look.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "determinant string, dependent string, tested bigint, broken bigint, holds boolean, witness string"


def refined(rows: DataFrame, attributes: list[str], by: tuple[str, ...]) -> DataFrame:
    """One row for the partition by `by`: for each other attribute the groups that test it and those that break it, the least broken group, and whether any group has two rows.

    Rows with a null or NaN in `by` are in no group. The groups are added up within tasks; only one row a
    task leaves the second aggregation.
    """
    others = [a for a in attributes if a not in by]
    each = [x for a in others for x in (F.count(a).alias(f"n_{a}"), F.min(a).alias(f"lo_{a}"), F.max(a).alias(f"hi_{a}"))]
    groups = rows.dropna(subset=list(by)).groupBy(*by).agg(F.count("*").alias("n_rows"), *each)
    name = F.concat_ws("|", *[F.col(a).cast("string") for a in by])
    totals = [F.coalesce(F.max(F.col("n_rows") > 1), F.lit(False)).alias("alike")]
    for a in others:
        breaks = F.col(f"lo_{a}") != F.col(f"hi_{a}")
        totals += [F.count_if(F.col(f"n_{a}") > 1).alias(f"t_{a}"), F.count_if(breaks).alias(f"b_{a}"), F.min(F.when(breaks, name)).alias(f"w_{a}")]
    return groups.agg(*totals)


def verdicts(rows: DataFrame, attributes: list[str], most: int = 2) -> DataFrame:
    """SCHEMA for every set of up to most attributes and every other attribute.

    tested: groups alike in the determinant with two rows or more where the dependent is not null;
    broken: those with two values; holds: whether none is broken, null if none was tested; witness:
    the least broken group. Two NaNs are one value. An empty table leaves all unchecked.
    """
    spark, keys, found = rows.sparkSession, [], []
    for size in range(1, most + 1):
        level = []
        for by in combinations(attributes, size):
            if any(set(k) <= set(by) for k in keys):
                found += [(",".join(by), a, 0, 0, None, None) for a in attributes if a not in by]
            else:
                level.append(by)
        if not level:
            continue
        each = [refined(rows, attributes, by).select(F.lit(",".join(by)).alias("by"), "alike", F.array(*[F.struct(F.lit(a).alias("a"), F.col(f"t_{a}").alias("t"), F.col(f"b_{a}").alias("b"), F.col(f"w_{a}").alias("w")) for a in attributes if a not in by]).alias("x")) for by in level]
        # one row for each set of a level: as many as there are sets
        for r in reduce(DataFrame.union, each).collect():
            if not r["alike"]:
                keys.append(tuple(r["by"].split(",")))
            found += [(r["by"], a, t, b, None if not t else not b, w) for a, t, b, w in r["x"]]
    return spark.createDataFrame(found, SCHEMA)


def audited(found: DataFrame, claims: list[tuple[str, str, str, bool]]) -> DataFrame:
    """claims (id, determinant, dependent, settles) against verdicts: id, state (true, false or null), tested, broken, witness.

    A claim that the determinant settles the dependent is true if it holds; one that it must not be
    taken to is true if it does not. What is unchecked stays null for both, and so does a claim about
    attributes that were not looked at.
    """
    c = found.sparkSession.createDataFrame(claims, "id string, determinant string, dependent string, settles boolean")
    out = c.join(found, ["determinant", "dependent"], "left")
    return out.select("id", (F.col("holds") == F.col("settles")).alias("state"), F.coalesce("tested", F.lit(0)).alias("tested"), F.coalesce("broken", F.lit(0)).alias("broken"), "witness")
