"""Scores of a blind batch: by arm, with abstentions, false acceptance and consistency over mates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import share


def scores(rows: DataFrame, arm: str, truth: str, predicted: str, failed: str, pair: Column) -> DataFrame:
    """Per arm: labelled, accepted (a prediction), unknown (none), exact, accuracy, accuracy_accepted, unknown_rate, false_acceptance, failures, pairs, reversals, reversal_consistency.

    pair names two rows of an arm that are mates. A pair is consistent if its labels are reversed
    and both predictions are exact; mates meet in one aggregation by arm and pair, whose counts make
    the arm's in a second. A pair with one row in the arm, or more than two, is none. Rates are null
    where there is nothing to divide by.
    """
    exact = F.coalesce(F.col(predicted) == F.col(truth), F.lit(False))
    mates = rows.groupBy(F.col(arm).alias("arm"), pair.alias("_pair")).agg(
        F.count("*").alias("n"), F.count(predicted).alias("a"), F.count_if(exact).alias("e"), F.count_if(failed).alias("f"), (F.min(truth) != F.max(truth)).alias("r")
    )
    two = F.col("n") == 2
    out = mates.groupBy("arm").agg(
        F.sum("n").alias("labelled"), F.sum("a").alias("accepted"), F.sum("e").alias("exact"), F.sum("f").alias("failures"), F.count_if(two).alias("pairs"), F.count_if(two & (F.col("e") == 2) & F.col("r")).alias("reversals")
    )
    c = F.col
    return out.select(
        "arm", "labelled", "accepted", (c("labelled") - c("accepted")).alias("unknown"), "exact", share(c("exact"), c("labelled")).alias("accuracy"), share(c("exact"), c("accepted")).alias("accuracy_accepted"),
        share(c("labelled") - c("accepted"), c("labelled")).alias("unknown_rate"), (c("accepted") - c("exact")).alias("false_acceptance"), "failures", "pairs", "reversals", share(c("reversals"), c("pairs")).alias("reversal_consistency"),
    )
