"""Bounded-space online best-fit packing of token pieces into sequences.

At most OPEN_BINS bins are open at a time. A bitset has bit f set if some open bin has f tokens
free; the tightest bin for a piece of length n is the lowest set bit from n on. When one more bin
would exceed the bound, the fullest open one closes. Each task packs its own documents and tells
which bins it leaves open, and how full they are. These, at most OPEN_BINS for each task, are packed
once more as pieces of their own, the fullest first, by tasks that take the bins of up to JOINED of
the first; so the result hardly depends on the number of tasks. Only bins that move are joined back.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import few, texts, written
from .encoding import encoder

CAPACITY, OPEN_BINS, END_ID = 2048, 4096, 0
#: Tasks whose open bins one task packs again.
JOINED = 64
SCHEMA = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
ARROW = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


class BestFit:
    """Places pieces one by one; first is the number of the first sequence."""

    def __init__(self, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, first: int = 0):
        self.capacity, self.limit, self.next = capacity, open_bins, first
        self.bits, self.by_free, self.open = 0, [[] for _ in range(capacity + 1)], 0

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        found = bins.pop()
        if not bins:
            self.bits &= ~(1 << free)
        self.open -= 1
        return found

    def _put(self, name: int, free: int) -> None:
        if not free:
            return
        if self.open >= self.limit:
            self._take((self.bits & -self.bits).bit_length() - 1)
        self.by_free[free].append(name)
        self.bits |= 1 << free
        self.open += 1

    def place(self, length: int) -> tuple[int, int]:
        """(sequence, offset) for a piece of 1 to capacity tokens."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            name = self._take(free)
        else:
            free, name = self.capacity, self.next
            self.next += 1
        self._put(name, free - length)
        return name, self.capacity - free

    def left_open(self) -> list[tuple[int, int]]:
        """(sequence, tokens in it) of the bins that are open."""
        return [(name, self.capacity - free) for free, bins in enumerate(self.by_free) for name in bins]


def moved_bins(bins: DataFrame, capacity: int, open_bins: int) -> DataFrame:
    """Open bins (sequence_id, length) packed again: old, sequence_id, base (its offset there), for those that move into another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit, holder = BestFit(capacity, open_bins), []
        for batch in batches:
            names, sizes = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            rows = []
            for k in np.argsort(-sizes, kind="stable").tolist():
                found, offset = fit.place(int(sizes[k]))
                if offset:
                    rows.append((int(names[k]), holder[found], offset))
                else:
                    holder.append(int(names[k]))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], names=["old", "sequence_id", "base"])

    return bins.select("sequence_id", "length").mapInArrow(run, "old bigint, sequence_id bigint, base bigint")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> DataFrame:
    """Per piece of each document: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and the end id; null and empty texts are the end id alone. Only documents
    over capacity are cut. Within an Arrow batch the longer pieces go first. Rows keep their
    multiplicity (a repeated row is packed again); a null doc_id is carried; other columns are
    dropped; an empty table has no pieces. sequence_id is the first task's number and a counter; what
    the first tasks have done is written, so it is the same however often one is retried.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        code, bins = encoder(tokenizer), BestFit(capacity, open_bins, TaskContext.get().partitionId() << 36)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            rows = []
            for name, ids in zip(batch.column(0).to_pylist(), code.encode_all(batch.column(1))):
                last = len(ids) // (4 * capacity)  # the piece that has the end id
                for k in range(last):
                    rows.append((capacity, name, k, k * capacity, zlib.crc32(ids[4 * k * capacity : 4 * (k + 1) * capacity])))
                rest = ids[4 * last * capacity :]
                rows.append((len(rest) // 4 + 1, name, last, last * capacity, zlib.crc32(end, zlib.crc32(rest))))
            rows.sort(key=lambda r: -r[0])
            placed = [bins.place(r[0]) for r in rows]
            columns = [[r[1] for r in rows], [r[2] for r in rows], [r[3] for r in rows], [r[0] for r in rows], [r[4] for r in rows], [p[0] for p in placed], [p[1] for p in placed]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, ARROW.types)], schema=ARROW)
        left = bins.left_open()  # rows of no document: piece is -1
        n = len(left)
        columns = [[None] * n, [-1] * n, [0] * n, [used for _, used in left], [0] * n, [name for name, _ in left], [0] * n]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, ARROW.types)], schema=ARROW)

    rows = few(texts(docs))
    tasks = rows.rdd.getNumPartitions()
    first = written(rows.mapInArrow(run, SCHEMA), "pieces", 0)  # not coalesced: a task's number names its sequences
    moved = written(moved_bins(first.where("piece < 0").coalesce(max(1, tasks // JOINED)), capacity, open_bins), "moved", 1)
    pieces = first.where("piece >= 0").join(moved.select(F.col("old").alias("sequence_id"), F.col("sequence_id").alias("into"), "base"), "sequence_id", "left")
    return pieces.select("doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("into", "sequence_id").alias("sequence_id"), (F.col("offset") + F.coalesce("base", F.lit(0))).alias("offset"))
