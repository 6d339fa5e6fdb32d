"""Gates: what is measured, what it must reach, what it rests on, and what falls with it.

A gate passes if what is measured reaches its declared floor; nothing measured is null, neither a
pass nor a failure. Gates read through others: a gate stands only if it and all that it reads through
pass, so its standing is the least rung along every path. Paths may run in cycles; gates that read
through each other are one and stand or fall together. A gate that fails re-opens all gates that
read through it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import written

# fixed values: gates, whether each is required, what kind of support its pass rests on, its rung, and the gates it reads through
GATES = [
    ("G1", True, "verification", "bounded-verified", []),
    ("G2", True, "evidence", "bounded-verified", ["G1"]),
    ("G3", True, "evidence", "bounded-verified", ["G2"]),
    ("G4", True, "verification", "bounded-verified", ["G1"]),
    ("G5", False, "measurement", "bounded-experiment", []),
    ("G6", True, "verification", "bounded-verified", ["G1"]),
    ("G7", True, "verification", "definition", []),
    ("G8", True, "measurement", "bounded-experiment", ["G1", "G2"]),
    ("G9", True, "proof", "exact", ["G1", "G2"]),
]
# fixed values: rungs from the weakest, kinds of support, and floors
LADDER = ["construction-target", "definition", "bounded-experiment", "bounded-verified", "exact"]
SUPPORT_KINDS = ["evidence", "proof", "verification", "measurement"]
FLOORS = {"labelled-per-construction-determination": 2, "labelled-per-construction-holdout": 2, "negative-cases": 6, "corpus-coverage-rate": 0.01, "g8-corpus-answerability": 0.15}


def declared(gates: list[tuple] = GATES, ladder: list[str] = LADDER, kinds: list[str] = SUPPORT_KINDS) -> list[tuple]:
    """gates, if every rung, kind and gate that one names is declared; else an error says which is not."""
    names = [g[0] for g in gates]
    if len(set(names)) < len(names):
        raise ValueError("a gate is declared twice")
    for name, _, kind, rung, reads in gates:
        if kind not in kinds or rung not in ladder or not set(reads) <= set(names):
            raise ValueError(f"{name} names a kind of support, a rung or a gate that is not declared")
    return gates


def measured(one: DataFrame, rules: dict[str, tuple[Column, Column, float]]) -> DataFrame:
    """gate, reached, of, floor, passes from a table of one row: rules gives for each gate a numerator, a denominator and the least share. Where the denominator is 0 nothing is measured and passes is null."""
    each = []
    for gate, (n, of, floor) in rules.items():
        n, of = n.cast("long"), of.cast("long")
        each.append(F.struct(F.lit(gate).alias("gate"), n.alias("reached"), of.alias("of"), F.lit(float(floor)).alias("floor"), F.when(of > 0, n >= of * F.lit(float(floor))).alias("passes")))
    return one.select(F.explode(F.array(*each)).alias("g")).select("g.*")


def _met(a: DataFrame, b: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """a join of tables that both grow: never a broadcast, whose rows would pass through the driver however small their files are."""
    return a.join(b.hint("merge"), on, how)


def _reach(edges: DataFrame, values: DataFrame, value: str, best) -> DataFrame:
    """values (id, value) with the best value of all that edges (from, to) lead to, itself included: one join a round until nothing changes."""
    now = written(values.select("id", value), "reach")
    while True:
        seen = _met(edges, now.select(F.col("id").alias("to"), F.col(value).alias("far")), "to").groupBy(F.col("from").alias("id")).agg((F.min if best is F.least else F.max)("far").alias("far"))
        after = written(_met(now, seen, "id", "left").select("id", best(F.col(value), F.coalesce("far", value)).alias(value), (best(F.col(value), F.coalesce("far", value)) != F.col(value)).alias("changed")), "reach")
        now = after.select("id", value)
        if after.where("changed").isEmpty():
            return now


def strong_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, component: the least id of the nodes that lead to each other.

    Rounds: nodes without a way in or out are components of their own and go. Of the rest, each
    takes the least id that leads to it, its colour; the nodes of a colour that lead back to the
    node it is named after are that node's component, and go too. At least one component of every
    colour goes in a round.
    """
    left = written(nodes.select("id").distinct(), "nodes")
    edges = written(edges.select("from", "to").where("`from` <> `to`").distinct(), "ways")
    done = None
    add = lambda some: written(some if done is None else done.union(some), "strong")
    while not left.isEmpty():
        ends = _met(edges.select(F.col("from").alias("id")).distinct(), edges.select(F.col("to").alias("id")), "id", "left_semi")
        alone = _met(left, ends, "id", "left_anti")
        if not alone.isEmpty():
            done = add(alone.select("id", F.col("id").alias("component")))
            left = written(_met(left, ends, "id", "left_semi"), "nodes")
        else:
            colour = _reach(edges.select(F.col("to").alias("from"), F.col("from").alias("to")), left.withColumn("colour", F.col("id")), "colour", F.least)
            of = lambda end: colour.select(F.col("id").alias(end), F.col("colour").alias(f"c_{end}"))
            within = written(_met(_met(edges, of("from"), "from"), of("to"), "to").where("c_from = c_to").select("from", "to"), "within")
            back = _reach(within, colour.select("id", (F.col("id") == F.col("colour")).alias("back")), "back", F.greatest)
            found = written(_met(colour, back.where("back"), "id").select("id", F.col("colour").alias("component")), "found")
            done = add(found)
            left = written(_met(left, found, "id", "left_anti"), "nodes")
        kept = left.select(F.col("id"))
        edges = written(_met(_met(edges, kept.withColumnRenamed("id", "from"), "from", "left_semi"), kept.withColumnRenamed("id", "to"), "to", "left_semi"), "ways")
    return nodes.select("id", F.col("id").alias("component")).limit(0) if done is None else done


def minima(nodes: DataFrame, edges: DataFrame, value: str) -> DataFrame:
    """id, component, value: the least value of all that a node leads to by edges (from, to), itself included; nulls count as nothing.

    Cycles are condensed first, so the rounds of the fixpoint are as many as the longest way between components.
    """
    parts = written(strong_components(nodes, edges), "parts")
    of = _met(nodes, parts, "id")
    own = of.groupBy("component").agg(F.min(value).alias("v"))
    name = lambda end: parts.select(F.col("id").alias(end), F.col("component").alias(f"c_{end}"))
    ways = _met(_met(edges, name("from"), "from"), name("to"), "to").where("c_from <> c_to").select(F.col("c_from").alias("from"), F.col("c_to").alias("to")).distinct()
    ways = written(ways, "condensed")
    top = own.select(F.col("component").alias("id"), F.coalesce("v", F.lit(float("inf"))).alias("v"))
    least = _reach(ways, top, "v", F.least)
    found = least.select(F.col("id").alias("component"), F.when(F.col("v") < float("inf"), F.col("v")).alias(value))
    return _met(parts, found, "component").select("id", "component", value)


def standing(results: DataFrame, reads: DataFrame) -> DataFrame:
    """Per gate of results (gate, passes): component, stands (it and all it reads through pass), and state.

    state: `passes`, `fails`, `unmeasured` (its own), or `meaningless` where its own is a pass but
    one that it reads through fails or is unmeasured. reads: rows (from, to), from reads through to.
    """
    rank = F.when(F.col("passes"), 2.0).when(F.col("passes").isNull(), 1.0).otherwise(0.0)
    least = minima(results.select(F.col("gate").alias("id"), rank.alias("least")), reads, "least")
    out = results.join(least.withColumnRenamed("id", "gate"), "gate")
    stands = F.col("least") == 2.0
    state = F.when(F.col("passes").isNull(), "unmeasured").when(~F.col("passes"), "fails").when(stands, "passes").otherwise("meaningless")
    return out.withColumn("stands", stands).withColumn("state", state).drop("least")


def reopened(results: DataFrame, reads: DataFrame) -> DataFrame:
    """gate, reopens: for each gate that fails, every other gate that reads through it, at any distance."""
    now = written(results.where("not passes").select("gate", F.col("gate").alias("reopens")), "reopens")
    n = now.count()
    while True:
        further = now.join(reads.select(F.col("to").alias("reopens"), F.col("from").alias("next")), "reopens").select("gate", F.col("next").alias("reopens"))
        now = written(now.union(further).distinct(), "reopens")
        before, n = n, now.count()
        if n == before:
            return now.where("gate <> reopens")
