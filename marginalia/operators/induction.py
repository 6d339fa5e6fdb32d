"""Feature families: which sets of features decide a label without contradiction, and what they predict."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _key(features: list[str]):
    return F.to_json(F.array(*[F.col(f).cast("string") for f in features]))


def without_conflicts(examples: DataFrame, context: list[str], label: str) -> DataFrame:
    """Examples but those whose whole context carries several labels: conflicts are local, and left out of induction."""
    good = examples.groupBy(*context).agg(F.count_distinct(label).alias("_labels")).where("_labels = 1").drop("_labels")
    on = reduce(lambda a, b: a & b, [examples[c].eqNullSafe(good[c]) for c in context])
    return examples.join(good, on, "left_semi")


def decision_tables(examples: DataFrame, hypotheses: list[list[str]], label: str) -> DataFrame:
    """Rows (hypothesis, key, label, n, labels) of every hypothesis's table."""
    rows = examples.withColumn("_h", F.explode(F.array(*[F.struct(F.lit(k).alias("hypothesis"), _key(h).alias("key")) for k, h in enumerate(hypotheses)])))
    return rows.groupBy(F.col("_h.hypothesis").alias("hypothesis"), F.col("_h.key").alias("key")).agg(F.min(label).alias("label"), F.count("*").alias("n"), F.count_distinct(label).alias("labels"))


def charged(examples: DataFrame, hypotheses: list[list[str]], label: str, order: str, fuel: int) -> DataFrame:
    """Checks of a sequential replay per hypothesis, up to and with its first counterexample: hypothesis, checks, refuted, spent_before, exhausted.

    A table grows example by example, so a key's first counterexample is its first row with another
    label than that of its first row. The first places of each key's labels are enough to find it;
    the checks are then the rows up to it, a count. Nothing is sorted but the labels of a key. Rows
    without a label contradict nothing, and a key that begins with one is never contradicted.
    """
    own = F.explode(F.array(*[F.struct(F.lit(k).alias("hypothesis"), _key(h).alias("key")) for k, h in enumerate(hypotheses)]))
    rows = examples.select(own.alias("_h"), F.col(label).alias("label"), F.col(order).alias("at"))
    firsts = rows.groupBy("_h.hypothesis", "_h.key", "label").agg(F.min("at").alias("at"))
    of_key = Window.partitionBy("hypothesis", "key")
    first = F.min(F.struct("at", "label")).over(of_key)
    clash = firsts.withColumn("first", first).where("at > first.at and label is not null and first.label is not null")
    refuted = clash.groupBy("hypothesis").agg(F.min("at").alias("until"))
    declared = examples.sparkSession.createDataFrame([(k,) for k in range(len(hypotheses))], "hypothesis int").join(refuted, "hypothesis", "left")
    # a row for each declared hypothesis
    counts = examples.select(F.col(order).alias("at")).crossJoin(F.broadcast(declared)).groupBy("hypothesis").agg(F.count_if(F.col("until").isNull() | (F.col("at") <= F.col("until"))).alias("checks"), F.max(F.col("until").isNotNull()).alias("refuted"))
    before = F.sum("checks").over(Window.orderBy("hypothesis")) - F.col("checks")
    return counts.withColumn("spent_before", before).withColumn("exhausted", F.col("spent_before") + F.col("checks") > fuel)


def predicted(queries: DataFrame, examples: DataFrame, context: list[str], hypotheses: list[list[str]], label: str) -> DataFrame:
    """queries with status, reason and prediction.

    Contested: the query's own context carries several labels. Else only hypotheses without a
    counterexample count; all of them must cover the query, and agree.
    """
    usable = without_conflicts(examples, context, label)
    tables = decision_tables(usable, hypotheses, label)
    dead = tables.where("labels > 1").select("hypothesis").distinct()
    alive = tables.join(dead, "hypothesis", "left_anti")
    names = queries.sparkSession.createDataFrame([(k,) for k in range(len(hypotheses))], "hypothesis int")
    survivors = names.join(dead, "hypothesis", "left_anti")
    contested = examples.groupBy(*context).agg((F.count_distinct(label) > 1).alias("_contested"))
    q = queries.withColumn("_keys", F.array(*[F.struct(F.lit(k).alias("hypothesis"), _key(h).alias("key")) for k, h in enumerate(hypotheses)])).withColumn("_id", F.to_json(F.array(*[F.col(c).cast("string") for c in context])))
    each = q.select("_id", F.explode("_keys").alias("k")).distinct().select("_id", "k.hypothesis", "k.key")
    each = each.join(F.broadcast(survivors), "hypothesis").join(alive.select("hypothesis", "key", "label"), ["hypothesis", "key"], "left")
    votes = each.groupBy("_id").agg(F.count("*").alias("_n"), F.count("label").alias("_covered"), F.count_distinct("label").alias("_labels"), F.min("label").alias("_label"))
    contested = contested.withColumn("_id", F.to_json(F.array(*[F.col(c).cast("string") for c in context]))).select("_id", "_contested")
    out = q.join(votes, "_id", "left").join(contested, "_id", "left")
    known = (F.col("_n") > 0) & (F.col("_covered") == F.col("_n")) & (F.col("_labels") == 1)
    is_contested = F.coalesce("_contested", F.lit(False))
    status = F.when(is_contested, "Contested").when(F.coalesce(known, F.lit(False)), "CandidateReading").otherwise("Unknown")
    reason = F.when(is_contested | F.coalesce(known, F.lit(False)), None).when(F.col("_n").isNull(), "hypothesis-family-refuted").when(F.col("_covered") < F.col("_n"), "uncovered-context").otherwise("surviving-hypotheses-disagree")
    return out.select(*queries.columns, status.alias("status"), reason.alias("reason"), F.when(status == "CandidateReading", F.col("_label")).alias("prediction"))
