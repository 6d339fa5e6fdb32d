"""What a reading leaves open: spans of frames that lie over each other, spans that the fold refuses, and agents that no label may be.

Every match of every frame is a span. Starts and ends are swept in the order of the text with a
running sum, the depth: how many spans lie over a place. Ends come before starts at the same place,
since a span ends before its end. All of a passage's figures are made where its text is read: no
span is a row, and only sums by group are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import frames


def spans(passages: DataFrame, text: str, of: list, keep: list[str]) -> DataFrame:
    """The columns keep, matches and found: arrays of a passage's matches of the frames, and of those that the fold keeps."""
    t = F.when(F.length(text) > 0, F.col(text))
    arrays: dict[str, Column] = {}
    for k, (_, rx, roles) in enumerate(of):
        arrays |= frames.frame_arrays(t, k, rx, roles)
    parts = [F.coalesce(frames.frame_matches(k, name, roles), F.array().cast(frames._KIND)) for k, (name, _, roles) in enumerate(of)]
    return passages.withColumns(arrays).select(*keep, F.concat(*parts).alias("matches")).withColumn("found", frames.folded(F.col("matches")))


def sweep(matches: Column) -> Column:
    """Of an array of spans: deepest, covered (characters under a span), shared (under several)."""
    point = lambda at, d: F.struct(at.alias("at"), F.lit(d).alias("d"))
    points = F.array_sort(F.concat(F.transform(matches, lambda m: point(m["start"], 1)), F.transform(matches, lambda m: point(m["end"], -1))))
    zero = F.struct(*[F.lit(0).alias(c) for c in ("at", "depth", "deepest")], *[F.lit(0).cast("long").alias(c) for c in ("covered", "shared")])

    def step(s: Column, p: Column) -> Column:
        under = lambda least: F.when(s["depth"] >= least, p["at"] - s["at"]).otherwise(0)
        depth = s["depth"] + p["d"]
        return F.struct(p["at"].alias("at"), depth.alias("depth"), F.greatest(s["deepest"], depth).alias("deepest"), (s["covered"] + under(1)).alias("covered"), (s["shared"] + under(2)).alias("shared"))

    return F.aggregate(points, zero, step)


def scan(passages: DataFrame, key: str, group: str, text: str, of: list, admissible) -> DataFrame:
    """Per group: passages, read (a frame stands), multi_frame (several do), spans, refused (the fold drops), dirty_agent (spans that stand whose agent is not admissible), deepest, covered, shared.

    admissible is a condition on an agent, of a column. Keys are unique; passages without text are
    passages that nothing reads.
    """
    dirty = F.size(F.filter("found", lambda f: f["agent"].isNotNull() & ~admissible(f["agent"])))
    rows = spans(passages, text, of, [key, group]).select(group, F.size("matches").alias("spans"), F.size("found").alias("stand"), dirty.alias("dirty"), sweep(F.col("matches")).alias("s"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return rows.groupBy(group).agg(
        F.count("*").alias("passages"), F.count_if(F.col("stand") > 0).alias("read"), F.count_if(F.col("stand") > 1).alias("multi_frame"), total("spans").alias("spans"), total(F.col("spans") - F.col("stand")).alias("refused"),
        total("dirty").alias("dirty_agent"), F.coalesce(F.max("s.deepest"), F.lit(0)).alias("deepest"), total("s.covered").alias("covered"), total("s.shared").alias("shared"),
    )
