"""Exact finite operators: six-bit words, syllogisms, ternary addresses, residues. All from range()."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The two-bit codes of proposition kinds, and which terms the premises of each figure join (0 S, 1 M, 2 P).
KIND_CODES = {"A": "11", "E": "10", "I": "01", "O": "00"}
FIGURE_WIRES = {1: ((1, 2), (0, 1)), 2: ((2, 1), (0, 1)), 3: ((1, 2), (1, 0)), 4: ((2, 1), (1, 0))}


def _bit(n: Column, i: int) -> Column:
    return F.shiftright(n, i).bitwiseAND(F.lit(1))


def words(spark: SparkSession) -> DataFrame:
    """The 64 words, bottom position first: code, bits and the three transformations."""
    n = F.col("id").cast("int")
    bits = F.concat(*[_bit(n, i).cast("string") for i in range(6)])
    return spark.range(64).select(n.alias("code"), bits.alias("bits")).select(
        "code",
        "bits",
        F.translate("bits", "01", "10").alias("complement"),
        F.reverse("bits").alias("reverse"),
        F.concat(F.substring("bits", 4, 3), F.substring("bits", 1, 3)).alias("exchange"),
    )


def flipped(bits: Column, position: Column) -> Column:
    """bits with one position (from 1) changed."""
    return F.concat(F.substring(bits, F.lit(1), position - 1), F.translate(F.substring(bits, position, F.lit(1)), "01", "10"), F.substring(bits, position + 1, F.lit(6)))


def line_context(spark: SparkSession) -> DataFrame:
    """Structural facts of each of the 384 lines."""
    lines = words(spark).select("bits", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("position"))
    p = F.col("position")
    own, pair = F.substring("bits", p, F.lit(1)), F.when(p <= 3, p + 3).otherwise(p - 3)
    return lines.select(
        "bits",
        "position",
        F.when(own == "1", "yang").otherwise("yin").alias("polarity"),
        F.substring("bits", 1, 3).alias("lower"),
        F.substring("bits", 4, 3).alias("upper"),
        p.isin(2, 5).alias("central"),
        (own.cast("int") == p % 2).alias("proper"),
        pair.alias("corresponding"),
        (own != F.substring("bits", pair, F.lit(1))).alias("opposite"),
        flipped(F.col("bits"), p).alias("changed"),
    )


def pairings(spark: SparkSession) -> DataFrame:
    """The edges between positions: neighbours in a stratum, and correspondence three apart."""
    k = F.col("id").cast("int") + 1
    strata = spark.range(3).select(F.lit("strata").alias("relation"), (2 * k - 1).alias("a"), (2 * k).alias("b"))
    return strata.union(spark.range(3).select(F.lit("correspondence"), k, k + 3))


def pairing_route(spark: SparkSession, start: int = 1) -> DataFrame:
    """The cycle through all positions that takes the two relations in turn."""
    edges = pairings(spark)
    both = edges.union(edges.select("relation", F.col("b").alias("a"), F.col("a").alias("b")))
    at = spark.range(1).select(F.lit(0).alias("step"), F.lit(start).alias("position"))
    out = at
    for step in range(1, 7):
        relation = "strata" if step % 2 else "correspondence"
        at = at.join(F.broadcast(both.where(F.col("relation") == relation)), F.col("position") == F.col("a")).select(F.lit(step).alias("step"), F.col("b").alias("position"))
        out = out.union(at)
    return out


def moods(spark: SparkSession) -> DataFrame:
    """The 64 moods with their six-bit codes: first bits of the three kinds, then second bits."""
    kinds = F.array(*map(F.lit, "AEIO"))
    n = F.col("id").cast("int")
    part = [F.element_at(kinds, (F.floor(n / 4 ** (2 - k)) % 4 + 1).cast("int")) for k in range(3)]
    code = F.create_map(*[F.lit(x) for kv in KIND_CODES.items() for x in kv])
    named = spark.range(64).select(n.alias("ordinal"), F.concat(*part).alias("mood"))
    of = [code[F.substring("mood", k + 1, 1)] for k in range(3)]
    return named.withColumn("bits", F.concat(*[F.substring(c, 1, 1) for c in of], *[F.substring(c, 2, 1) for c in of]))


def _term(t: int) -> int:
    """Mask of the atoms inside a term: atom a is bit a, and lies in term t if a has bit t."""
    return sum(1 << a for a in range(8) if a >> t & 1)


def _holds(kind: Column, subject: int, predicate: int, mask: Column) -> Column:
    inside = mask.bitwiseAND(F.lit(_term(subject) & _term(predicate))) != 0
    outside = mask.bitwiseAND(F.lit(_term(subject) & ~_term(predicate))) != 0
    return F.when(kind == "A", ~outside).when(kind == "E", ~inside).when(kind == "I", inside).otherwise(outside)


def model_truths(spark: SparkSession) -> DataFrame:
    """Every mood, figure, policy and occupancy mask, with the truth of its propositions: a product of generated ranges of fixed size."""
    figures = spark.range(1, 5).select(F.col("id").cast("int").alias("figure"))
    policies = spark.createDataFrame([("boolean",), ("terms-nonempty",)], "policy string")
    masks = spark.range(1, 256).select(F.col("id").cast("int").alias("mask"))
    all_ = moods(spark).select("mood").crossJoin(F.broadcast(figures)).crossJoin(F.broadcast(policies)).crossJoin(F.broadcast(masks))
    mask = F.col("mask")

    def by_figure(kind: Column, which: int) -> Column:
        out = F.lit(None).cast("boolean")
        for figure, wires in FIGURE_WIRES.items():
            out = F.when(F.col("figure") == figure, _holds(kind, *wires[which], mask)).otherwise(out)
        return out

    nonempty = reduce(lambda a, b: a & b, [mask.bitwiseAND(F.lit(_term(t))) != 0 for t in range(3)])
    return all_.select(
        "mood",
        "figure",
        "policy",
        "mask",
        ((F.col("policy") == "boolean") | nonempty).alias("admissible"),
        by_figure(F.substring("mood", 1, 1), 0).alias("major"),
        by_figure(F.substring("mood", 2, 1), 1).alias("minor"),
        _holds(F.substring("mood", 3, 1), 0, 2, mask).alias("conclusion"),
    )


def syllogism_atlas(spark: SparkSession, fuel: int = 255) -> DataFrame:
    """Status of the 512 contracts: Refuted by the least countermodel, Valid if all masks were visited, else Unknown."""
    seen = model_truths(spark).where(F.col("mask") <= fuel)
    counter = F.when(F.col("admissible") & F.col("major") & F.col("minor") & ~F.col("conclusion"), F.col("mask"))
    keys = ["mood", "figure", "policy"]
    found = seen.groupBy(*keys).agg(F.min(counter).alias("countermodel"), F.count_if("admissible").alias("admissible"), F.count_if(F.col("admissible") & F.col("major") & F.col("minor")).alias("satisfied"))
    status = F.when(F.col("countermodel").isNotNull(), "Refuted").when(F.lit(fuel) < 255, "Unknown").otherwise("Valid")
    valid = status == "Valid"
    return found.select(*keys, status.alias("status"), F.coalesce("countermodel", F.lit(fuel)).alias("checked"), "countermodel", F.when(valid, F.col("admissible")).alias("admissible"), F.when(valid, F.col("satisfied")).alias("satisfied"))


def addresses(spark: SparkSession) -> DataFrame:
    """The 729 ternary addresses: head ordinal and digits, zan, the address, its features and the successor within the head."""
    n = F.col("id").cast("int")
    head, zan = F.floor(n / 9).cast("int") + 1, n % 9 + 1
    ternary = lambda x, width: F.lpad(F.conv(x.cast("string"), 10, 3), width, "0")
    rows = spark.range(729).select(head.alias("head"), zan.alias("zan")).withColumn("digits", ternary(F.col("head") - 1, 4))
    digit = lambda k: F.substring("digits", k, 1).cast("int")
    return rows.select(
        "head",
        "zan",
        "digits",
        F.concat("digits", ternary(F.col("zan") - 1, 2)).alias("address"),
        digit(1).alias("fang"),
        digit(2).alias("zhou"),
        digit(3).alias("bu"),
        digit(4).alias("jia"),
        F.floor((F.col("zan") - 1) / 3).cast("int").alias("phase_group"),
        ((F.col("zan") - 1) % 3).alias("phase_within"),
        F.when(F.col("zan") < 9, F.col("zan") + 1).alias("next_zan"),
    )


def decoded(address: Column) -> Column:
    """Struct (head, zan) of a six-digit ternary address; null if it is none."""
    number = lambda s: F.conv(s, 3, 10).cast("int") + 1
    return F.when(address.rlike("^[012]{6}$"), F.struct(number(F.substring(address, 1, 4)).alias("head"), number(F.substring(address, 5, 2)).alias("zan")))


def residues(value: Column, moduli: list[int], positive: bool = False) -> Column:
    """Remainders in 0..m-1, or in 1..m if positive."""
    out = [F.pmod(value, F.lit(m)) for m in moduli]
    return F.array(*[F.when(r == 0, F.lit(m)).otherwise(r) if positive else r for r, m in zip(out, moduli)])


def fibres(spark: SparkSession, families: list[list[int]], modulus: int) -> DataFrame:
    """Per family of moduli, the integers below modulus by what they leave: observation and members."""
    out = None
    for k, family in enumerate(families):
        rows = spark.range(modulus).select(F.lit(k).alias("family"), residues(F.col("id").cast("int"), family).alias("r"), F.col("id").cast("int").alias("x"))
        out = rows if out is None else out.union(rows)
    grouped = out.groupBy("family", F.array_join(F.transform("r", lambda x: x.cast("string")), ",").alias("observation"))
    return grouped.agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x.cast("string")), ",").alias("members"), F.count("*").alias("n"))


def reconstructed(spark: SparkSession, a: int, b: int) -> DataFrame:
    """Integers below a * b from their remainders by a and b, through the idempotents that select one remainder each."""
    m = a * b
    select_a = next(x for x in range(m) if x % a == 1 % a and x % b == 0)
    select_b = next(x for x in range(m) if x % a == 0 and x % b == 1 % b)
    x = F.col("id").cast("int")
    rows = spark.range(m).select(x.alias("x"), F.pmod(x, F.lit(a)).alias("ra"), F.pmod(x, F.lit(b)).alias("rb"))
    return rows.withColumn("back", F.pmod(F.col("ra") * select_a + F.col("rb") * select_b, F.lit(m)))


def octaves(spark: SparkSession, count: int, targets: int = 22) -> DataFrame:
    """Numbers 1..count as fractions of an octave, and the nearest of equally spaced targets on the circle."""
    n = F.col("id").cast("int")
    place = F.log2(n) - F.floor(F.log2(n))
    rows = spark.range(1, count + 1).select(n.alias("n"), place.alias("place"))
    step = F.pmod(F.floor(F.col("place") * targets + 0.5), F.lit(targets)).cast("int")
    rows = rows.withColumn("nearest", step)
    gap = F.abs(F.col("place") - F.col("nearest") / targets)
    return rows.select("n", F.round("place", 9).alias("place"), "nearest", F.round(F.least(gap, 1 - gap), 9).alias("distance"))
