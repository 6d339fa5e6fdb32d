"""Monte-Carlo null of a coverage: how many targets do random positions reach?

Random numbers are counter-based: the position of draw i in trial t is a hash of (t, i), so it does
not depend on partitions or order. A task draws all trials of the rows it reads, finds each
position's nearest target by binary search, and keeps one bit mask for each trial: which targets it
has reached. Masks are the only rows that leave a task, and trials that have reached all targets
there are not drawn any further.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.session import ship_package

# fixed values: multipliers of a public 32-bit finalizer, and the odd number nearest 2**32 over the golden ratio
MIX_1, MIX_2, GOLDEN = 0x85EBCA6B, 0xC2B2AE35, 0x9E3779B9
_BLOCK = 1 << 20


def mixed(h: np.ndarray) -> np.ndarray:
    """A 32-bit finalizer: every bit of h moves every bit of the result."""
    h = h.astype(np.uint32, copy=True)
    for shift, by in ((16, MIX_1), (13, MIX_2)):
        h ^= h >> np.uint32(shift)
        h *= np.uint32(by)
    return h ^ (h >> np.uint32(16))


def positions(trials: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Positions in [0, 1), a row for each draw and a column for each trial."""
    draws = draws.astype(np.uint64)
    folded = mixed((draws & np.uint64(0xFFFFFFFF)).astype(np.uint32) ^ mixed((draws >> np.uint64(32)).astype(np.uint32)))
    salt = (trials.astype(np.uint64) * np.uint64(GOLDEN)).astype(np.uint32)
    return mixed(folded[:, None] ^ salt[None, :]) / 4294967296.0


def nearest(at: np.ndarray, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest of sorted targets on the circle of length 1, and the distance; of two as near, the one before."""
    n = len(targets)
    after = np.searchsorted(targets, at)
    before = after - 1
    d_after = np.where(after < n, targets[after % n] - at, 1 + targets[0] - at)
    d_before = np.where(before >= 0, at - targets[before], at + 1 - targets[-1])
    closer = d_after < d_before
    return np.where(closer, after % n, before % n), np.where(closer, d_after, d_before)


def reached(rows: DataFrame, draw: str, targets: list[float], near: float, trials: int) -> DataFrame:
    """trial (from 1), mask: the targets that any row's position of the trial is within near of. At most 62 targets, on a circle of length 1 and over 2 * near apart. A null draw draws nothing."""
    ship_package(rows.sparkSession)
    goal = np.sort(np.array(targets, float))
    if len(goal) > 62:
        raise ValueError("at most 62 targets fit in a mask")
    if np.diff([*goal, goal[0] + 1]).min() <= 2 * near:
        raise ValueError("a position can be near two targets")
    full = (1 << len(targets)) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, mask = np.arange(1, trials + 1), np.zeros(trials, np.int64)
        for batch in batches:
            draws = batch.column(0).drop_null().to_numpy(zero_copy_only=False)
            step = 64
            while len(draws):
                open_ = np.flatnonzero(mask != full)
                if not len(open_):
                    break
                step = max(1, min(step, _BLOCK // len(open_)))
                which, distance = nearest(positions(number[open_], draws[:step]), goal)
                bits = np.where(distance <= near, np.int64(1) << which.astype(np.int64), 0)
                mask[open_] |= np.bitwise_or.reduce(bits, axis=0)
                draws = draws[step:]
                step *= 2
        yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(mask)], names=["trial", "mask"])

    parts = rows.select(F.col(draw).cast("long").alias("draw")).mapInArrow(run, "trial bigint, mask bigint")
    return parts.groupBy("trial").agg(F.bit_or("mask").alias("mask"))


def coverage_null(rows: DataFrame, draw: str, position, targets: list[float], near: float, trials: int) -> DataFrame:
    """One row: observed (targets that the rows' own positions reach), trials, full (trials that reach all), share of these, least, greatest and sum of the targets reached, as_many (trials that reach at least the observed number)."""
    bits = F.lit(0).cast("long")
    for k, t in enumerate(sorted(targets)):
        d = F.abs(position - F.lit(t))
        bits = bits.bitwiseOR(F.when(F.least(d, 1 - d) <= near, F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
    seen = rows.agg(F.bit_count(F.coalesce(F.bit_or(bits), F.lit(0).cast("long"))).alias("observed"))
    null = reached(rows, draw, targets, near, trials).select("trial", F.bit_count("mask").alias("n"))
    both = null.crossJoin(F.broadcast(seen))  # one row
    full = F.count_if(F.col("n") == len(targets))
    return both.agg(
        F.first("observed").alias("observed"), F.count("*").alias("trials"), full.alias("full"), F.round(full / F.count("*"), 4).alias("share"),
        F.min("n").alias("least"), F.max("n").alias("greatest"), F.sum("n").alias("reached"), F.count_if(F.col("n") >= F.col("observed")).alias("as_many"),
    )
