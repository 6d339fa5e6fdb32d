"""What five filters remove, in every order: a relational replay.

A narrow pass turns each document into five failure bits and a digest of its text; the least doc_id
of each digest decides which documents repeat an earlier text. Every document then meets the 120
orders, which are broadcast (a fixed table), its first failing step in that order is computed, its
five steps are exploded and counted by part, order and step. All counts are sums that Spark adds up
within each task before the shuffle, so that 600 rows for a part leave a task, whatever it has read.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import texts, written

# fixed values: the filters' letters, their limits, the white space between words and the marks
LETTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 50, 65, 5
SPACE = r"[\x20\x09-\x0D]+"
MARKS = "[#$%&*|]"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Failure of a document from its text (never null) and its words. E is not here: it takes the whole table.
RULES: dict[str, Callable[[Column, Column], Column]] = {
    "A": lambda text, words: F.size(words) < LEAST_WORDS,
    "B": lambda text, words: 100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT * F.size(words),
    "C": lambda text, words: 100 * (F.length(text) - F.length(F.translate(text, CAPITALS, ""))) > MOST_CAPITALS * F.length(text),
    "D": lambda text, words: text.rlike(MARKS),
}


def bit(letter: str) -> int:
    return 1 << LETTERS.index(letter)


def failures(docs: DataFrame, part: str = "source") -> DataFrame:
    """Per row: doc_id, part, and flags (bit k: fails the filter LETTERS[k]).

    Null texts are empty. Rows with a null doc_id have no smaller one, and rows that repeat a doc_id
    do not repeat each other. A null part is the empty string. Other columns are dropped.
    """
    rows = texts(docs, F.coalesce(F.col(part).cast("string"), F.lit("")).alias("_part"))
    rows = rows.select("doc_id", F.col("_part").alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("words", F.array_remove(F.split("text", SPACE), ""))
    own = sum((F.when(rule(F.col("text"), F.col("words")), bit(k)).otherwise(0) for k, rule in RULES.items()), F.lit(0))
    rows = written(rows.select("doc_id", "part", own.alias("own"), F.unhex(F.sha2("text", 256)).alias("digest")), "flags", 0)
    # written, so that adaptive execution can split a text that a third of the rows have
    least = written(rows.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1").select("digest", "least"), "least", 2)
    flags = F.col("own") + F.when(F.col("doc_id") > F.col("least"), bit("E")).otherwise(0)
    return rows.join(least, "digest", "left").select("doc_id", "part", flags.alias("flags"))


def orders(spark) -> DataFrame:
    """The 120 orders: filter_order and the bits of its steps."""
    return spark.createDataFrame([("".join(o), [bit(k) for k in o]) for o in permutations(LETTERS)], "filter_order string, bits array<int>")


def replay(rows: DataFrame) -> DataFrame:
    """Rows (part, flags, good, toxic) through every order: one row for each part, order and step."""
    met = rows.crossJoin(F.broadcast(orders(rows.sparkSession)))
    last = len(LETTERS)
    first = F.lit(last)
    for k in reversed(range(last)):
        first = F.when(F.col("flags").bitwiseAND(F.col("bits")[k]) != 0, k).otherwise(first)
    steps = met.select("part", "flags", "good", "toxic", "filter_order", first.alias("first"), F.posexplode("bits").alias("k", "bit"))
    here, fails = F.col("first") == F.col("k"), F.col("flags").bitwiseAND(F.col("bit")) != 0
    counts = steps.groupBy("part", "filter_order", "k").agg(
        F.count_if(F.col("first") > F.col("k")).alias("kept"),
        F.count_if(here).alias("removed"),
        F.count_if(fails & (F.col("first") < F.col("k"))).alias("redundant"),
        F.count_if(F.col("flags") == F.col("bit")).alias("unique_fails"),
        F.count_if(here & F.col("good")).alias("good_lost"),
        F.count_if(here & F.col("toxic")).alias("toxic_lost"),
    )
    counts = counts.withColumn("step", F.col("k") + 1)
    own = F.substring(F.col("filter_order"), F.col("step"), F.lit(1))
    counts = counts.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", own)))
    return counts.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """Rows (part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for each value of part, order of the five filters and step.

    A document counts as good (toxic) if any row of labels has its doc_id and quality (toxic) 1;
    without labels it is neither. Rows that repeat a doc_id count each. Empty documents fail A
    alone, or A and E. An empty table has no parts, so no rows. Very long texts are one row of bits
    after the first pass. A part that holds most documents is summed within tasks like the others.
    """
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    rows = failures(docs, part).join(marks, "doc_id", "left")
    return replay(rows.select("part", "flags", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")))
