"""Questions of declared types, answers that name what they derive from, and a verifier that derives them again.

An answer is a row (type, q, state, reason, missing, answer); what it rests on are rows (type, q,
ref, side) beside it, so an answer that rests on many records is as many rows and no long list.
States: Answered, Contested (records on both sides), Unknown (with a reason, and what is missing),
Refused (an undeclared type or one out of scope), Inconsistent (the store itself is at fault).

The verifier has the answers, what they rest on and the store, not the way they were found: it
joins the references to the store, derives each answer from these alone, and takes the multiset
difference both ways.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ANSWER = ["type", "q", "state", "reason", "missing", "answer"]
# fixed values: types of questions, and what a gloss is refused for
TYPES = {"Q1": "reading", "Q2": "comparison", "Q3": "warrant", "Q4": "counterfactual", "Q5": "consistency", "Q6": "gloss", "Q7": "judgement"}
GLOSS = "glosses-are-not-licensed"


def _answers(rows: DataFrame, type_: str, state: Column, reason: Column, missing: Column, answer: Column) -> DataFrame:
    said = state.isin("Answered", "Contested")
    return rows.select(F.lit(type_).alias("type"), F.col("q").cast("string").alias("q"), state.alias("state"), F.when(~said, reason).alias("reason"), F.when(state == "Unknown", missing).alias("missing"), F.when(said, answer).alias("answer"))


def _refs(rows: DataFrame, type_: str, ref: Column, side: Column) -> DataFrame:
    return rows.select(F.lit(type_).alias("type"), F.col("q").cast("string").alias("q"), ref.cast("string").alias("ref"), side.alias("side"))


def relation(a: str, b: str) -> Column:
    """Of two readings (structs agent, recipient, theme): alike, with agent and recipient exchanged, or other."""
    x, y = F.col(a), F.col(b)
    same = x["agent"].eqNullSafe(y["agent"]) & x["recipient"].eqNullSafe(y["recipient"]) & x["theme"].eqNullSafe(y["theme"])
    swapped = ~x["agent"].eqNullSafe(x["recipient"]) & x["agent"].eqNullSafe(y["recipient"]) & x["recipient"].eqNullSafe(y["agent"]) & x["theme"].eqNullSafe(y["theme"])
    return F.when(same, "SameRelation").when(swapped, "RoleReversal").otherwise("DifferentRelation")


def _compared(rows: DataFrame) -> DataFrame:
    """rows (q, left, right): structs that are null where a side is not read."""
    reason = F.when(F.col("left").isNull(), "left-side-outside-declared-grammar").otherwise("right-side-outside-declared-grammar")
    state = F.when(F.col("left").isNull() | F.col("right").isNull(), "Unknown").otherwise("Answered")
    return _answers(rows, "Q2", state, reason, F.lit("a reading of either side"), relation("left", "right"))


def comparison(questions: DataFrame, readings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """questions (q, a, b) against readings (id, roles), roles null where nothing is read. Rests on both."""
    side = lambda end, name: readings.select(F.col("id").alias(end), F.col("roles").alias(name))
    rows = questions.join(side("a", "left"), "a", "left").join(side("b", "right"), "b", "left")
    refs = _refs(questions, "Q2", F.col("a"), F.lit("left")).union(_refs(questions, "Q2", F.col("b"), F.lit("right")))
    return _compared(rows), refs


def _warranted(rows: DataFrame) -> DataFrame:
    """rows (q, n, missing_n, retracted_n)."""
    c = F.col
    state = F.when(c("retracted_n") > 0, "Unknown").when(c("missing_n") > 0, "Inconsistent").when(c("n") > 0, "Answered").otherwise("Unknown")
    reason = F.when(c("retracted_n") > 0, "warrant-refers-to-retracted-evidence").when(c("missing_n") > 0, "warrant-names-records-not-in-the-store").otherwise("conclusion-without-a-warrant")
    return _answers(rows, "Q3", state, reason, F.lit("a warrant resting on evidence that is still active"), F.concat(F.lit("present="), c("n").cast("string")))


def _fates(refs: DataFrame, store: DataFrame) -> DataFrame:
    """refs (q, ref) counted by what the store (id, side, retracted) has of them."""
    s = store.select(F.col("id").cast("string").alias("ref"), "retracted")
    found = refs.join(s, "ref", "left").groupBy("q")
    return found.agg(F.count("ref").alias("n"), F.count_if(F.col("ref").isNotNull() & F.col("retracted").isNull()).alias("missing_n"), F.count_if("retracted").alias("retracted_n"))


def warrant(conclusions: DataFrame, store: DataFrame) -> tuple[DataFrame, DataFrame]:
    """conclusions (q, ref), a row for each record that one names (null: none), against store (id, side, retracted). Rests on them."""
    refs = _refs(conclusions, "Q3", F.col("ref"), F.lit("named"))
    return _warranted(_fates(conclusions.select("q", F.col("ref").cast("string").alias("ref")), store)), refs.where("ref is not null")


def _survivors(rows: DataFrame) -> DataFrame:
    """rows (q, side, holds, fails): the record's own side (null: not in the store) and its group's counts."""
    c = F.col
    before = (c("holds") > 0).cast("int") + (c("fails") > 0).cast("int")
    after = (c("holds") - F.when(c("side"), 1).otherwise(0) > 0).cast("int") + (c("fails") - F.when(~c("side"), 1).otherwise(0) > 0).cast("int")
    answer = F.concat(F.lit("survivors="), after.cast("string"), F.lit(";changed="), (after != before).cast("string"))
    return _answers(rows, "Q4", F.when(c("side").isNull(), "Unknown").otherwise("Answered"), F.lit("no-such-evidence-record"), F.lit("the id of a record present in the store"), answer)


def _groups(store: DataFrame) -> DataFrame:
    return store.where("not retracted").groupBy("group").agg(F.count_if("side").alias("holds"), F.count_if(~F.col("side")).alias("fails"))


def counterfactual(questions: DataFrame, store: DataFrame) -> tuple[DataFrame, DataFrame]:
    """questions (q, removed): what of a record's group is left of verdicts without it; store (id, group, side, retracted). Rests on the group less the record, named by both."""
    active = store.where("not retracted").select(F.col("id").alias("removed"), "group", "side")
    rows = questions.join(active, "removed", "left").join(_groups(store), "group", "left")
    refs = rows.where("side is not null")
    return _survivors(rows), _refs(refs, "Q4", F.col("removed"), F.lit("without")).union(_refs(refs, "Q4", F.col("group"), F.lit("group")))


def consistency(store: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One answer: whether every id is in the store once and has a side. Rests on the store as a whole, which needs no references."""
    one = store.agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.count_if(F.col("side").isNull() | F.col("id").isNull()).alias("bad")).withColumn("q", F.lit("store"))
    fine = (F.col("n") == F.col("ids")) & (F.col("bad") == 0)
    out = _answers(one, "Q5", F.when(fine, "Answered").otherwise("Inconsistent"), F.lit("duplicate-or-incomplete-records"), F.lit(None).cast("string"), F.concat(F.lit("records="), F.col("n").cast("string")))
    return out, _refs(one.where("false"), "Q5", F.col("q"), F.col("q"))


def gloss(questions: DataFrame) -> tuple[DataFrame, DataFrame]:
    none = F.lit(None).cast("string")
    return _answers(questions, "Q6", F.lit("Refused"), F.lit(GLOSS), none, none), _refs(questions.where("false"), "Q6", none, none)


def _judged(rows: DataFrame) -> DataFrame:
    """rows (q, holds, fails)."""
    c = F.col
    state = F.when((c("holds") > 0) & (c("fails") > 0), "Contested").when(c("holds") + c("fails") > 0, "Answered").otherwise("Unknown")
    answer = F.when(state == "Contested", F.concat(F.lit("holds="), c("holds").cast("string"), F.lit(";fails="), c("fails").cast("string"))).when(c("holds") > 0, "holds").otherwise("fails")
    return _answers(rows, "Q7", state, F.lit("no-judgement-of-this-claim"), F.lit("a judgement of the claim"), answer)


def judgement(questions: DataFrame, store: DataFrame) -> tuple[DataFrame, DataFrame]:
    """questions (q, claim) against the active records (id, group, side) of the claim's group. Rests on all of these, each on its side; never a vote."""
    active = store.where("not retracted").select("id", F.col("group").alias("claim"), "side")
    asked = questions.join(active, "claim", "left")
    counts = questions.join(_groups(store).withColumnRenamed("group", "claim"), "claim", "left").select("q", F.coalesce("holds", F.lit(0)).alias("holds"), F.coalesce("fails", F.lit(0)).alias("fails"))
    return _judged(counts), _refs(asked.where("id is not null"), "Q7", F.col("id"), F.when(F.col("side"), "holds").otherwise("fails"))


def asked(*parts: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """All answers, and all that they rest on."""
    return reduce(DataFrame.union, [a for a, _ in parts]), reduce(DataFrame.union, [r for _, r in parts])


def refused(questions: DataFrame) -> DataFrame:
    """questions (q, type): those of no declared type are refused, never answered by analogy."""
    none = F.lit(None).cast("string")
    return _answers(questions.where(~F.coalesce(F.col("type").isin(list(TYPES)), F.lit(False))), "undeclared", F.lit("Refused"), F.lit("undeclared-question-type"), none, none)


def violations(answers: DataFrame, refs: DataFrame) -> DataFrame:
    """Answers that break the contract: type, q, rule.

    I1: an answer other than on the store as a whole rests on something. I2: Unknown has a reason
    and says what is missing; Refused and Inconsistent have a reason. I7: Contested has records on
    both sides, and is a state of judgements alone.
    """
    sides = refs.groupBy("type", "q").agg(F.count("*").alias("n"), F.count_if(F.col("side") == "holds").alias("holds"), F.count_if(F.col("side") == "fails").alias("fails"))
    a = answers.join(sides, ["type", "q"], "left")
    c, none = F.col, lambda x: F.coalesce(x, F.lit(0)) == 0
    rule = (
        F.when((c("state") == "Answered") & (c("type") != "Q5") & none(c("n")), "I1")
        .when((c("state") == "Unknown") & (c("reason").isNull() | c("missing").isNull()), "I2")
        .when(c("state").isin("Refused", "Inconsistent") & c("reason").isNull(), "I2")
        .when((c("state") == "Contested") & ((c("type") != "Q7") | none(c("holds")) | none(c("fails"))), "I7")
        .when(~c("state").isin("Answered", "Contested", "Unknown", "Refused", "Inconsistent"), "I0")
    )
    return a.withColumn("rule", rule).where("rule is not null").select("type", "q", "rule")


def rederived(answers: DataFrame, refs: DataFrame, store: DataFrame, readings: DataFrame) -> DataFrame:
    """The answers that the references and the store give; Q1, Q5 and Q6 rest on none and are not here."""
    of = lambda t: refs.where(F.col("type") == t)
    names = lambda t: answers.where(F.col("type") == t).select("q")
    r = readings.select(F.col("id").cast("string").alias("ref"), "roles")
    sides = of("Q2").join(r, "ref", "left").groupBy("q").agg(F.first(F.when(F.col("side") == "left", F.col("roles")), True).alias("left"), F.first(F.when(F.col("side") == "right", F.col("roles")), True).alias("right"))
    q2 = _compared(sides)
    fates = names("Q3").join(_fates(of("Q3").select("q", "ref"), store), "q", "left")
    q3 = _warranted(fates.select("q", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "missing_n", "retracted_n")]))
    pairs = of("Q4").groupBy("q").agg(F.max(F.when(F.col("side") == "without", F.col("ref"))).alias("removed"), F.max(F.when(F.col("side") == "group", F.col("ref"))).alias("group"))
    own = store.where("not retracted").select(F.col("id").cast("string").alias("removed"), F.col("group").cast("string").alias("group"), "side")
    rows = names("Q4").join(pairs, "q", "left").join(own, ["removed", "group"], "left").join(_groups(store).withColumn("group", F.col("group").cast("string")), "group", "left")
    q4 = _survivors(rows)
    s = store.where("not retracted").select(F.col("id").cast("string").alias("ref"), F.when(F.col("side"), "holds").otherwise("fails").alias("own"))
    judged = of("Q7").join(s, "ref", "left").groupBy("q").agg(F.count_if((F.col("side") == "holds") & (F.col("own") == "holds")).alias("holds"), F.count_if((F.col("side") == "fails") & (F.col("own") == "fails")).alias("fails"))
    judged = names("Q7").join(judged, "q", "left").select("q", F.coalesce("holds", F.lit(0)).alias("holds"), F.coalesce("fails", F.lit(0)).alias("fails"))
    return reduce(DataFrame.union, [q2, q3, q4, _judged(judged)])


def verified(answers: DataFrame, refs: DataFrame, store: DataFrame, readings: DataFrame) -> DataFrame:
    """Rows of answers that do not follow (said) and those that do instead (follows), with `side` telling which."""
    own = answers.where(F.col("type").isin("Q2", "Q3", "Q4", "Q7")).select(*ANSWER)
    again = rederived(answers, refs, store, readings).select(*ANSWER)
    return own.exceptAll(again).withColumn("side", F.lit("said")).union(again.exceptAll(own).withColumn("side", F.lit("follows")))
