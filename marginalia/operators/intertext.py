"""Citations and containment between texts, and single edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens


def normalized(t: Column, variants: list[tuple[str, str]] = ()) -> Column:
    """Words of a text joined by a space, then one-to-one variants mapped."""
    out = F.array_join(tokens(t), " ")
    return F.translate(out, "".join(a for a, _ in variants), "".join(b for _, b in variants)) if variants else out


#: Quotes that are sent to the passages, at most; with more, hashes of passages are shuffled.
QUOTES = 50_000


def contained(quotes: DataFrame, quote: str, passages: DataFrame, passage: str, key: str, n: int = 5) -> DataFrame:
    """Pairs in which the words of quote stand in a row in passage, perhaps once for each place; both normalized, key names a passage.

    A quote is looked up by its first n words (all of them if fewer), for the lengths that quotes
    have. Few quotes are a table that is broadcast, and what follows a place is compared where the
    passage is read, so no passage is shuffled. With many, only hashes and keys of passages are
    joined; texts are joined to the candidates, which are then compared.
    """
    words = F.split(quote, " ")
    q = quotes.withColumn("_n", F.least(F.size(words), F.lit(n)))
    q = q.withColumn("_gram", F.xxhash64(F.slice(words, F.lit(1), F.col("_n"))))
    sizes = q.groupBy("_n").agg(F.count("*").alias("quotes")).collect()  # at most n
    lengths, few = sorted(r["_n"] for r in sizes if r["_n"]), sum(r["quotes"] for r in sizes) <= QUOTES
    own = passages if few else passages.select(key, passage)
    places = None
    for k in lengths:
        # arrays of the words that begin runs, those after them, and so on
        runs = F.arrays_zip(*[F.slice("_w", j + 1, F.greatest(F.size("_w") - (k - 1), F.lit(0))).alias(f"w{j}") for j in range(k)])
        # outer: else Spark would infer a filter on the array's size and split every text twice
        at = own.withColumn("_w", F.split(passage, " ")).select(*own.columns, "_w", F.posexplode_outer(runs).alias("_at", "_x")).where("_at is not null")
        at = at.withColumn("_gram", F.xxhash64(F.array(*[f"_x.w{j}" for j in range(k)]))).drop("_x")
        mine = q.where(F.col("_n") == k)
        if few:
            same = F.array_join(F.slice("_w", F.col("_at") + 1, F.size(words)), " ") == F.col(quote)
            found = at.join(F.broadcast(mine), "_gram").where(same).drop("_w", "_at", "_gram", "_n")
        else:
            found = at.select(key, "_gram").distinct().join(mine.select("_gram").distinct(), "_gram", "left_semi")
            found = mine.join(found, "_gram").drop("_gram", "_n").join(passages, key)
            found = found.where(F.contains(F.concat(F.lit(" "), F.col(passage), F.lit(" ")), F.concat(F.lit(" "), F.col(quote), F.lit(" "))))
        places = found if places is None else places.unionByName(found)
    return quotes.join(passages.limit(0)) if places is None else places


def citation_status(found: Column, known: Column, length: Column, least: int) -> Column:
    """First that fits: none (no quote), too-short, not-in-corpus, found, not-found."""
    return F.when(length.isNull() | (length == 0), "none").when(length < least, "too-short").when(~known, "cited-work-not-in-corpus").when(found, "found-in-cited-work").otherwise("not-found-in-cited-work")


def one_edit(a: Column, b: Column) -> Column:
    """Place (from 1) of the only differing element of two arrays of one length; null if none or several differ."""
    places = F.filter(F.sequence(F.lit(1), F.size(a)), lambda i: ~F.get(a, i - 1).eqNullSafe(F.get(b, i - 1)))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (F.size(places) == 1), F.get(places, F.lit(0)))
