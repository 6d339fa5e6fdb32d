"""Chains of pages by pointer jumping: ends, cycles and orders in rounds that grow with the logarithm of the length.

Every page has at most one way on: to the page it names as the next one, or, if it is a redirect, to
its target, which counts no step. A round replaces each pointer by its pointer's pointer, so after k
rounds it spans 2**k hops. Only pages that have not come to an end yet take part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import written

PAIR = "struct<hops:bigint,steps:bigint>"


def _jumped(now: DataFrame) -> DataFrame:
    """Pointers (id, to, hops, steps, least) spanning twice as far; to is null at an end, and least is of the ids passed."""
    y = now.select(F.col("id").alias("to"), F.col("to").alias("y_to"), F.col("end").alias("y_end"), F.col("hops").alias("y_hops"), F.col("steps").alias("y_steps"), F.col("least").alias("y_least"))
    there = F.col("y_hops").isNotNull()
    return now.join(y, "to", "left").select(
        "id",
        F.when(there, F.col("y_to")).alias("to"),
        F.when(there & F.col("y_to").isNull(), F.col("y_end")).otherwise(F.col("end")).alias("end"),
        (F.col("hops") + F.coalesce("y_hops", F.lit(0))).alias("hops"),
        (F.col("steps") + F.coalesce("y_steps", F.lit(0))).alias("steps"),
        F.least("least", F.coalesce("y_least", "least")).alias("least"),
    )


def pointers(edges: DataFrame) -> DataFrame:
    """edges (id, to, redirect): to is null where a page names no next one; rows whose id repeats keep the one with the least target."""
    one = edges.groupBy("id").agg(F.min(F.struct(F.col("to").isNull(), "to", "redirect")).alias("e"))
    return one.select("id", F.col("e.to").alias("to"), F.coalesce(F.col("e.redirect"), F.lit(False)).alias("redirect"))


def resolved_chains(edges: DataFrame) -> DataFrame:
    """Per page: id, redirect, end (the last page it comes to; null where a cycle is entered), hops and steps to it, cycle (the least page of the cycle it enters), on_cycle, stop.

    stop: `end` (the last page names none), `missing` (it names a page that is not there), `loop`.
    hops counts pages passed, steps leaves out redirects. Rounds: the logarithm of the number of
    pages where there are cycles, else of the longest chain.
    """
    own = written(pointers(edges), "pointers")
    exists = own.select(F.col("id").alias("to"), F.lit(True).alias("there"))
    first = own.join(exists, "to", "left").withColumn("goes", F.coalesce("there", F.lit(False)))
    missing = first.where("to is not null and not goes").select(F.col("id").alias("end"), F.lit(True).alias("gone"))
    at = F.when(F.col("goes"), F.col("to"))
    step = F.when(F.col("goes") & ~F.col("redirect"), 1).otherwise(0).cast("long")
    now = first.select("id", at.alias("to"), F.when(~F.col("goes"), F.col("id")).alias("end"), F.when(F.col("goes"), 1).otherwise(0).cast("long").alias("hops"), step.alias("steps"), F.col("id").alias("least"))
    now = written(now, "chains")
    pages, rounds, before = now.count(), 0, -1
    while True:
        unfinished = now.where("to is not null").count()
        if not unfinished or (1 << rounds) >= pages:
            break
        now, rounds = written(_jumped(now), "chains"), rounds + 1
        before = unfinished
    del before
    done = now.where("to is null").select("id", "end", "hops", "steps")
    # what is left never ends: pointers span every cycle by now, so what they point to is on one, and every page of a cycle is pointed to
    left = now.where("to is not null")
    cycles = left.select(F.col("to").alias("id")).distinct().join(left.select("id", F.col("least").alias("cycle")), "id")
    cycles = written(cycles, "cycles")
    tails = _tails(own, left.select("id"), cycles)
    plain = done.join(missing, "end", "left").select("id", "end", "hops", "steps", F.lit(None).cast("long").alias("cycle"), F.lit(False).alias("on_cycle"), F.when(F.col("gone"), "missing").otherwise("end").alias("stop"))
    return plain.union(tails).join(own.select("id", "redirect"), "id").select("id", "redirect", "end", "hops", "steps", "cycle", "on_cycle", "stop")


def _tails(own: DataFrame, left: DataFrame, cycles: DataFrame) -> DataFrame:
    """Of the pages that enter cycles: hops and steps to the first page of the cycle."""
    marks = cycles.select("id", "cycle", F.lit(True).alias("on"))
    start = own.join(left, "id", "left_semi").join(marks, "id", "left").withColumn("on", F.coalesce("on", F.lit(False)))
    now = start.select("id", F.when(~F.col("on"), F.col("to")).alias("to"), F.when(F.col("on"), F.col("id")).alias("end"), F.when(F.col("on"), 0).otherwise(1).cast("long").alias("hops"), F.when(F.col("on") | F.col("redirect"), 0).otherwise(1).cast("long").alias("steps"), F.col("id").alias("least"))
    now = written(now, "tails")
    while now.where("to is not null").limit(1).count():
        now = written(_jumped(now), "tails")
    entered = cycles.select(F.col("id").alias("end"), "cycle")
    return now.join(entered, "end").select("id", F.lit(None).cast(now.schema["end"].dataType).alias("end"), "hops", "steps", "cycle", (F.col("hops") == 0).alias("on_cycle"), F.lit("loop").alias("stop"))


def chain_orders(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """The pages of the chains from starts (id): start, step, page, without redirects.

    A chain ends where no next page is named or there, or before a page it has passed. A round adds,
    from all pages found, those 2**k hops further, so a chain of n pages takes log2(n) rounds.
    """
    ends = written(resolved_chains(edges), "ends")
    own = pointers(edges)
    there = own.select(F.col("id").alias("to"))
    jump = written(own.join(there, "to", "left_semi").select("id", "to", F.when(F.col("redirect"), 0).otherwise(1).cast("long").alias("w")), "jump")
    # pages on a chain: to its end, or the tail and once around the cycle
    around = ends.where("on_cycle").groupBy("cycle").agg(F.count("*").alias("round"))
    limits = ends.join(around, "cycle", "left").select("id", (F.col("hops") + F.coalesce("round", F.lit(1))).alias("pages"))
    rows = starts.select("id").distinct().join(limits, "id").select(F.col("id").alias("start"), "pages", F.lit(0).cast("long").alias("hop"), F.lit(0).cast("long").alias("step"), F.col("id").alias("page"))
    rows, span = written(rows, "orders"), 1
    longest = rows.agg(F.max("pages")).first()[0] or 0
    while span < longest:
        further = rows.join(jump.select(F.col("id").alias("page"), "to", "w"), "page").select("start", "pages", (F.col("hop") + span).alias("hop"), (F.col("step") + F.col("w")).alias("step"), F.col("to").alias("page")).where("hop < pages")
        rows = written(rows.union(further), "orders")
        span *= 2
        if span < longest:
            z = jump.select(F.col("id").alias("to"), F.col("to").alias("to2"), F.col("w").alias("w2"))
            jump = written(jump.join(z, "to").select("id", F.col("to2").alias("to"), (F.col("w") + F.col("w2")).alias("w")), "jump")
    plain = ends.where("not redirect").select(F.col("id").alias("page"))
    return rows.join(plain, "page", "left_semi").select("start", "step", "page")


def next_pages(pages: DataFrame, id_: str, name, links) -> DataFrame:
    """Edges (id, to, redirect) of pages that name each other: links is the array of names a page links to, in order.

    A name stands for the least page that has it; pages that share the name redirect to that one. A
    page's next is the first of its links that names another page; where none does, but there are
    links, the page is the last of its chain.
    """
    own = pages.select(F.col(id_).alias("id"), name.alias("name"), links.alias("links"))
    holders = written(own.where("name <> ''").groupBy("name").agg(F.min("id").alias("holder")), "names")
    named = own.select("id", "name").join(holders, "name", "left")
    redirects = named.where("holder < id").select("id", F.col("holder").alias("to"), F.lit(True).alias("redirect"))
    found = own.select("id", F.posexplode("links").alias("at", "link")).join(holders.select(F.col("name").alias("link"), F.col("holder").alias("to")), "link").where("to <> id")
    first = found.groupBy("id").agg(F.min(F.struct("at", "to")).alias("x")).select("id", "x.to")
    rest = named.where("holder is null or holder >= id").select("id").join(first, "id", "left").select("id", "to", F.lit(False).alias("redirect"))
    return redirects.union(rest)
