"""Append-only stores: hashes of claims, chains, retractions, judgements that are not votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def canonical_json(**fields: Column) -> Column:
    """Compact JSON with keys sorted, nulls kept."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def content_hash(grammar: Column, text: Column, expected: Column) -> Column:
    """Of the claim alone; expected is a struct (agent, recipient, theme)."""
    return F.sha2(canonical_json(grammar=grammar, text=text, expected=expected), 256)


def text_hash(grammar: Column, text: Column) -> Column:
    return F.sha2(canonical_json(grammar=grammar, text=text), 256)


def chained(log: DataFrame, stream: str, order: str, payload: Column) -> DataFrame:
    """log with hash, previous and the running position of each event in its stream; previous is the hash before, null first."""
    w = Window.partitionBy(stream).orderBy(order)
    return log.withColumn("hash", F.sha2(payload, 256)).withColumn("previous", F.lag("hash").over(w)).withColumn("position", F.row_number().over(w))


def chain_breaks(log: DataFrame, stream: str, order: str) -> DataFrame:
    """Events whose stated previous is not the hash of the event before."""
    w = Window.partitionBy(stream).orderBy(order)
    return log.withColumn("_before", F.lag("hash").over(w)).where(~F.col("previous").eqNullSafe(F.col("_before"))).drop("_before")


def append(store: DataFrame, new: DataFrame, key: str = "content_hash", name: str = "id") -> tuple[DataFrame, DataFrame]:
    """(rows to append, clashes): a claim that is there is no news; a name that is there with other content is a clash."""
    fresh = new.dropDuplicates([key]).join(store.select(key), key, "left_anti")
    clash = fresh.join(store.select(name).distinct(), name, "left_semi")
    return fresh.join(clash.select(name), name, "left_anti"), clash


def active(records: DataFrame, retractions: DataFrame, name: str = "id", target: str = "target_id", order: str = "seq") -> DataFrame:
    """Records that no later retraction withdraws."""
    r = retractions.select(F.col(target).alias(name), F.col(order).alias("_at"))
    r = r.groupBy(name).agg(F.max("_at").alias("_at"))
    return records.join(r, name, "left").where(F.col("_at").isNull() | (F.col("_at") <= F.col(order))).drop("_at")


def reconciled(judgements: DataFrame, claim: str, verdict: str) -> DataFrame:
    """Per claim: holds, fails, state; both sides make it Contested, however many they are."""
    holds, fails = F.count_if(F.col(verdict) == "holds"), F.count_if(F.col(verdict) == "fails")
    state = F.when((holds > 0) & (fails > 0), "Contested").when(holds + fails > 0, "Answered").otherwise("Unknown")
    return judgements.groupBy(claim).agg(holds.alias("holds"), fails.alias("fails"), state.alias("state"), F.when((holds > 0) & (fails == 0), "holds").when((fails > 0) & (holds == 0), "fails").alias("verdict"))


def conflicting_labels(records: DataFrame, text: str, label: str) -> DataFrame:
    """Texts that carry several labels."""
    return records.groupBy(text).agg(F.count("*").alias("n"), F.count_distinct(label).alias("labels")).where("labels > 1")
