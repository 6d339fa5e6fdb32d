"""Frequent runs of words, mined level by level, and the closed ones among them.

A run that occurs `least` times is made of runs one word shorter that do. So the runs of two words
are counted, then those of three where both runs of two are kept, then the longer ones, all lengths
at once, within stretches of kept runs of three. A run is named by two 64-bit hashes of the runs it
is made of, and counted with its prefix and suffix as plain numbers; words are read again only for
what is reported. A report of the most frequent closed runs needs none that occurs less often than
its last one does, so a floor of that count is found first, from pairs of frequent words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written

RUN = ["size", "h1", "h2"]
#: Frequent words whose pairs are counted for the floor, and rows of a table that is broadcast, at most.
FIRST, BROADCAST = 2000, 100_000


def _named(parts: Column, size: Column) -> Column:
    """The two hashes of a run from those of the runs it is made of."""
    return F.struct(F.xxhash64(F.transform(parts, lambda p: p["h1"]), size).alias("h1"), F.xxhash64(size, F.transform(parts, lambda p: p["h2"])).alias("h2"))


def _counted(places: DataFrame, least: int) -> DataFrame:
    """Runs of places (key, at, size, run, p, s) with at least `least` of these: size, h1, h2, n, a place (key, at), prefix p1, p2 and suffix s1, s2. Every value has a fixed width, so counting is a hash aggregation with a partial one before the shuffle."""
    flat = places.select("key", "at", "size", "run.h1", "run.h2", F.col("p.h1").alias("p1"), F.col("p.h2").alias("p2"), F.col("s.h1").alias("s1"), F.col("s.h2").alias("s2"))
    # one row gives all the firsts
    firsts = [F.first(c).alias(c) for c in ("key", "at", "p1", "p2", "s1", "s2")]
    return flat.groupBy(*RUN).agg(F.count("*").alias("n"), *firsts).where(F.col("n") >= least)


def _kept(places: DataFrame, runs: DataFrame) -> DataFrame:
    """Places (key, at, run) of the runs that are kept."""
    names = runs.select("h1", "h2")
    return places.select("key", "at", "run.h1", "run.h2").join(names, ["h1", "h2"], "left_semi").select("key", "at", F.struct("h1", "h2").alias("run"))


def _pairs(rows: DataFrame) -> DataFrame:
    """Places (key, at, a, b) of all runs of two words of rows (key, w)."""
    rest = F.greatest(F.size("w") - 1, F.lit(0))
    both = F.arrays_zip(F.slice("w", F.lit(1), rest).alias("a"), F.slice("w", F.lit(2), rest).alias("b"))
    return rows.select("key", F.posexplode(both).alias("at", "x")).select("key", "at", "x.a", "x.b")


def _of(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """The pairs both words of which are known, a table that is broadcast."""
    for c in ("a", "b"):
        pairs = pairs.join(F.broadcast(known.select(F.col("word").alias(c))), c, "left_semi")
    return pairs


def _floor(counted: DataFrame, many: int, least: int) -> int:
    """The greatest count that `many` of counted pairs reach; `least` if there are not so many."""
    best = counted.orderBy(F.desc("n")).limit(many).agg(F.count("*").alias("pairs"), F.min("n").alias("n")).first()
    return max(least, best["n"]) if best["pairs"] == many else least


def frequent(rows: DataFrame, key: str, words: Column, longest: int, least: int, most: int | None = None) -> DataFrame:
    """Runs of 2 to longest words (at least 4) with at least `least` places; see _counted.

    most: only so many closed runs will be asked for, the most frequent and what ties with them. A
    pair is held by a closed run of its count, and such a run holds longest - 1 pairs at most. So
    where most * (longest - 1) pairs reach a count, `most` closed runs do, and none below is asked
    for. Pairs of the FIRST words give such a count, whatever the other words' pairs are.
    """
    after = Window.partitionBy("key").orderBy("at")
    # texts are split once; from here on a word is its hash, and a pair the two hashes of its words
    rows = written(rows.select(F.col(key).alias("key"), F.transform(words, lambda w: F.xxhash64(w)).alias("w")), "hashes")
    pairs = _pairs(rows)
    counts = rows.select(F.explode("w").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    counts = written(counts.where(F.col("n") >= least), "words")
    # the ends of a pair are words, which closed() does not ask for
    run = F.struct(F.col("a").alias("h1"), F.col("b").alias("h2"))
    two = lambda pairs: pairs.select("key", "at", F.lit(2).alias("size"), run.alias("run"), run.alias("p"), run.alias("s"))
    runs2, known = None, counts
    if most:
        known = written(counts.orderBy(F.desc("n"), "word").limit(FIRST), "first")
        runs2 = written(_counted(two(_of(pairs, known)), least), "pairs")
        least = _floor(runs2, most * (longest - 1), least)
        # pairs with other words can reach the floor where more words than these do
        complete = counts.where(F.col("n") >= least).count() <= FIRST
        runs2 = written(runs2.where(F.col("n") >= least), "runs2") if complete else None
    if runs2 is None:
        known = counts.where(F.col("n") >= least)
        pairs = _of(pairs, known) if known.count() <= BROADCAST else pairs
        runs2 = written(_counted(two(pairs), least), "runs2")
    else:
        pairs = _of(pairs, known)
    two = two(pairs)
    kept = written(_kept(two, runs2), "places2")
    three = kept.select("key", "at", F.col("run").alias("p"), F.lead("run").over(after).alias("s"), F.lead("at").over(after).alias("next")).where("next = at + 1")
    three = three.select("key", "at", F.lit(3).alias("size"), _named(F.array("p", "s"), F.lit(3)).alias("run"), "p", "s")
    runs3 = written(_counted(three, least), "runs3")
    kept = written(_kept(three, runs3), "places3")
    # stretches: the runs of three at this place and those that follow it without a gap
    more = [F.struct(F.lead("at", k).over(after).alias("at"), F.lead("run", k).over(after).alias("run")) for k in range(1, longest - 2)]
    stretch = kept.select("key", "at", F.array(F.struct("at", "run"), *more).alias("x"))
    there = F.size(F.filter("x", lambda x, i: x["at"] == F.col("at") + i))
    stretch = stretch.select("key", "at", F.transform(F.slice("x", F.lit(1), there), lambda x: x["run"]).alias("x")).where(F.size("x") > 1)
    longer = stretch.select("key", "at", "x", F.explode(F.sequence(F.lit(2), F.size("x"))).alias("k"))
    one = lambda first, k: F.when(k == 1, F.get("x", first - 1)).otherwise(_named(F.slice("x", first, k), k + 2))
    k = F.col("k")
    longer = longer.select("key", "at", (k + 2).alias("size"), _named(F.slice("x", F.lit(1), k), k + 2).alias("run"), one(F.lit(1), k - 1).alias("p"), one(F.lit(2), k - 1).alias("s"))
    return runs2.union(runs3).union(written(_counted(longer, least), "runs4"))


def closed(runs: DataFrame) -> DataFrame:
    """Runs that no longer run of the same count holds. One word more at either end decides: a longer run that holds this one as often holds such a run as often."""
    end = lambda e: F.struct(F.col(f"{e}1").alias("h1"), F.col(f"{e}2").alias("h2"))
    ends = runs.where("size > 2").select((F.col("size") - 1).alias("size"), F.explode(F.array(end("p"), end("s"))).alias("e"), "n").select("size", "e.h1", "e.h2", "n")
    return runs.join(ends, [*RUN, "n"], "left_anti")


def top_closed(rows: DataFrame, key: str, words: Column, longest: int = 8, least: int = 8, most: int = 40) -> DataFrame:
    """The report: rank, gram, n of the most frequent closed runs; of equal counts the longer first, then by text.

    A greedy pass down that ranking that drops whatever a kept run holds with nine tenths of its
    count gives the same: a run before it counts no less, and one that holds it no more.
    """
    found = written(closed(frequent(rows, key, words, longest, least, most)), "closed")
    last = found.orderBy(F.desc("n"), F.desc("size")).limit(most).agg(F.min(F.struct("n", F.col("size"))).alias("x")).select("x.n", "x.size")
    edge = last.select(F.col("n").alias("n_"), F.col("size").alias("size_"))  # one row
    # ties at the edge are all read, then ordered by text
    near = found.join(F.broadcast(edge), (F.col("n") > F.col("n_")) | (F.col("n") == F.col("n_")) & (F.col("size") >= F.col("size_")))
    near = written(near.select(F.col("key").alias(key), F.col("size").alias("_size"), F.col("n").alias("_n"), F.col("at").alias("_at")), "near")
    # only the texts of reported runs are split
    texts = rows.join(F.broadcast(near) if near.count() <= BROADCAST else near, key).select("_size", "_n", "_at", words.alias("_words"))
    grams = texts.select(F.col("_n").alias("n"), F.col("_size").alias("size"), F.concat_ws(" ", F.slice("_words", F.col("_at") + 1, F.col("_size"))).alias("gram"))
    ranked = grams.orderBy(F.desc("n"), F.desc("size"), "gram").limit(most)
    return ranked.select(F.row_number().over(Window.orderBy(F.desc("n"), F.desc("size"), "gram")).alias("rank"), "gram", "n")
