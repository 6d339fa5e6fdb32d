"""Controlled relations: whole-sentence constructions, role permutations that examples refute, comparison."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The three constructions. The strict profile demands the full stop.
_SLOT = "「([^「」\\r\\n]{1,32})」"
CONSTRUCTIONS = [("grant", f"{_SLOT}授{_SLOT}{_SLOT}"), ("hand-over", f"{_SLOT}把{_SLOT}交给{_SLOT}"), ("receive", f"{_SLOT}获{_SLOT}所授{_SLOT}")]
ORDERS = list(permutations(range(3)))
MAX_UNITS = 256


def parsed(rows: DataFrame, text: str = "text", strict: bool = False) -> DataFrame:
    """rows with construction and slots (array of three); null where the sentence is outside the grammar."""
    end = "。$" if strict else "。?$"
    fits = F.octet_length(F.encode(F.col(text), "UTF-16BE")) <= 2 * MAX_UNITS
    name, slots = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    for construction, body in reversed(CONSTRUCTIONS):
        rx = f"^{body}{end}"
        hit = fits & F.col(text).rlike(rx)
        name = F.when(hit, construction).otherwise(name)
        slots = F.when(hit, F.array(*[F.regexp_extract(text, rx, k) for k in (1, 2, 3)])).otherwise(slots)
    return rows.withColumn("construction", name).withColumn("slots", slots)


def parsed_by_split(rows: DataFrame, text: str = "text") -> DataFrame:
    """The strict profile by cutting at brackets, with no pattern of the grammar: an independent check of parsed()."""
    cut = F.split(F.col(text), "[「」]", -1)
    odd = F.array(*[F.get(cut, F.lit(k)) for k in (0, 2, 4, 6)])
    name = F.lit(None).cast("string")
    for construction, seams in (("grant", ["", "授", "", "。"]), ("hand-over", ["", "把", "交给", "。"]), ("receive", ["", "获", "所授", "。"])):
        name = F.when(odd == F.array(*map(F.lit, seams)), construction).otherwise(name)
    slots = F.array(*[F.get(cut, F.lit(k)) for k in (1, 3, 5)])
    balanced = F.translate(F.regexp_replace(text, "[^「」]", ""), "「」", "01") == "010101"
    fine = (F.size(cut) == 7) & balanced & F.forall(slots, lambda s: F.length(s).between(1, 32) & ~s.rlike("[\\r\\n]")) & (F.octet_length(F.encode(F.col(text), "UTF-16BE")) <= 2 * MAX_UNITS)
    return rows.withColumn("construction", F.when(fine, name)).withColumn("slots", F.when(fine & name.isNotNull(), slots))


def candidates(spark: SparkSession) -> DataFrame:
    """Every construction with every order of roles: order[k] is the slot that role k takes."""
    return spark.createDataFrame([(c, k, list(o)) for c, _ in CONSTRUCTIONS for k, o in enumerate(ORDERS)], "construction string, ord int, roles_order array<int>")


def assigned(slots: Column, order: Column) -> Column:
    return F.transform(order, lambda k: F.get(slots, k))


def learned(training: DataFrame, fuel: int = 18, strict: bool = True) -> DataFrame:
    """The trace of a learner that checks orders in sequence: training has seq, id, text, roles (array).

    Rows (seq, id, construction, ord, checked, matches, survives) for the checks that fuel pays
    for, up to the first row outside the grammar or that refutes all orders left. Row order is
    semantics, so the training set, of 32 rows at most, is ranked by seq.
    """
    rows = parsed(training, strict=strict)
    tried = rows.join(F.broadcast(candidates(training.sparkSession)), "construction")
    tried = tried.withColumn("matches", F.coalesce(assigned(F.col("slots"), F.col("roles_order")) == F.col("roles"), F.lit(False)))
    before = Window.partitionBy("construction", "ord").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    tried = tried.withColumn("alive", F.coalesce(F.min("matches").over(before), F.lit(True))).where("alive")
    tried = tried.withColumn("checked", F.row_number().over(Window.orderBy("seq", "ord")))
    per_row = tried.groupBy("seq").agg(F.max("matches").alias("any_match"))
    stop = rows.where("construction is null").agg(F.min("seq").alias("outside")).crossJoin(per_row.where("not any_match").agg(F.min("seq").alias("refuted")))
    tried = tried.crossJoin(F.broadcast(stop))  # one row of bounds
    kept = tried.where((F.col("checked") <= fuel) & (F.col("seq") < F.coalesce("outside", F.lit(1 << 30))) & (F.col("seq") <= F.coalesce("refuted", F.lit(1 << 30))))
    return kept.select("seq", "id", "construction", "ord", "checked", "matches")


def learned_state(training: DataFrame, fuel: int = 18, strict: bool = True) -> DataFrame:
    """Orders left for each construction after the trace: construction, ord, roles_order."""
    trace = learned(training, fuel, strict)
    refuted = trace.where("not matches").select("construction", "ord").distinct()
    return candidates(training.sparkSession).join(refuted, ["construction", "ord"], "left_anti")


def read(rows: DataFrame, state: DataFrame, strict: bool = True) -> DataFrame:
    """rows with status, reason and roles: KnownFiniteGrammar if exactly one assignment of roles survives."""
    found = parsed(rows, strict=strict).join(F.broadcast(state), "construction", "left")
    found = found.withColumn("roles", F.when(F.col("roles_order").isNotNull(), assigned(F.col("slots"), F.col("roles_order"))))
    grouped = found.groupBy("id", "text").agg(F.max("construction").alias("construction"), F.collect_set("roles").alias("options"))
    known = F.size("options") == 1
    return grouped.select(
        "id",
        "construction",
        F.when(known, "KnownFiniteGrammar").otherwise("Unknown").alias("status"),
        F.when(F.col("construction").isNull(), "outside-controlled-grammar").when(~known, "ambiguous-role-mapping").alias("reason"),
        F.when(known, F.get("options", F.lit(0))).alias("roles"),
    )


def compared(a: Column, b: Column) -> Column:
    """SameRelation, RoleReversal (agent and recipient exchanged, both expressed), DifferentRelation, or Unknown if a side is null; arrays of roles."""
    same = a.eqNullSafe(b)
    of = lambda x, k: F.get(x, F.lit(k))
    swapped = of(a, 0).eqNullSafe(of(b, 1)) & of(a, 1).eqNullSafe(of(b, 0)) & of(a, 2).eqNullSafe(of(b, 2)) & of(a, 0).isNotNull() & of(a, 1).isNotNull()
    return F.when(a.isNull() | b.isNull(), "Unknown").when(same, "SameRelation").when(swapped, "RoleReversal").otherwise("DifferentRelation")
