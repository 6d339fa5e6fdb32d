"""Token-id output as directly addressable codes.

A segment is one binary value that holds the ids of consecutive documents. Each id is cut into
chunks of CHUNK_BITS from its low end; level 0 has the first chunk of every id, level k the
chunk k of those ids that need it. A bitmap per level says which entries continue on the next,
and a rank directory counts the set bits before every RANK_BITS of the bitmap, so the place of
an id's next chunk is a rank: one directory entry and at most RANK_BITS bits. Any token is read
without decoding its neighbours.

Bytes of a segment, all little-endian: magic 'DAC1', u4 levels, u4 documents, u4 tokens; u4
entries of each level; u4 offsets of documents (documents + 1); then per level its chunks (u1),
bitmap (np.packbits, little bit order) and directory (u4 per RANK_BITS).

Segments are rows of a Parquet table in the shared folder, so that any store Spark writes to
will do and the committer settles retried tasks. doc_ids stand beside the segment.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, texts, written
from .encoding import encoder

CHUNK_BITS, RANK_BITS = 8, 512
#: Ids of a segment, but for a longer document, which has one to itself.
SEGMENT_IDS = 1 << 19
END_ID = 0
MAGIC = b"DAC1"


def pack(ids: np.ndarray, offsets: np.ndarray) -> bytes:
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest >> np.uint32(CHUNK_BITS)
        goes_on = more != 0
        levels.append((rest.astype(np.uint8), goes_on))
        if not goes_on.any():
            break
        rest = more[goes_on]
    head = [MAGIC, np.array([len(levels), len(offsets) - 1, len(ids)], "<u4").tobytes()]
    head += [np.array([len(c) for c, _ in levels], "<u4").tobytes(), offsets.astype("<u4").tobytes()]
    body = []
    for chunks, bits in levels:
        blocks = np.add.reduceat(bits, np.arange(0, len(bits), RANK_BITS), dtype=np.uint32) if len(bits) else np.zeros(0, np.uint32)
        rank = np.concatenate([[0], np.cumsum(blocks)[:-1]]) if len(bits) else blocks
        body += [chunks.tobytes(), np.packbits(bits, bitorder="little").tobytes(), rank.astype("<u4").tobytes()]
    return b"".join(head + body)


class Segment:
    """A reader over the bytes of a segment; views, no copies."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a segment of directly addressable codes")
        n_levels, self.documents, self.tokens = (int(x) for x in np.frombuffer(data, "<u4", 3, 4))
        sizes = np.frombuffer(data, "<u4", n_levels, 16)
        at = 16 + 4 * n_levels
        self.offsets = np.frombuffer(data, "<u4", self.documents + 1, at)
        at += 4 * (self.documents + 1)
        self.levels = []
        for n in map(int, sizes):
            parts = []
            for kind, count in (("u1", n), ("u1", -(-n // 8)), ("<u4", -(-n // RANK_BITS))):
                parts.append(np.frombuffer(data, kind, count, at))
                at += parts[-1].nbytes
            self.levels.append(parts)

    def token(self, i: int) -> int:
        """The id at place i, through ranks only."""
        value = 0
        for k, (chunks, bits, rank) in enumerate(self.levels):
            value |= int(chunks[i]) << (CHUNK_BITS * k)
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // RANK_BITS
            before = np.unpackbits(bits[block * RANK_BITS // 8 : (i >> 3) + 1], bitorder="little")[: i - block * RANK_BITS]
            i = int(rank[block]) + int(before.sum())
        return value

    def ids(self) -> np.ndarray:
        """All ids, level by level."""
        out, places = np.zeros(self.tokens, np.uint32), np.arange(self.tokens)
        for k, (chunks, bits, _) in enumerate(self.levels):
            out[places] |= chunks.astype(np.uint32) << np.uint32(CHUNK_BITS * k)
            places = places[np.unpackbits(bits, count=len(chunks), bitorder="little").view(bool)]
        return out


SEGMENTS = "part int, seg int, doc_ids array<bigint>, n_tokens bigint, codes binary"


def write_tokens(docs: DataFrame, tokenizer: str, segment_ids: int = SEGMENT_IDS) -> DataFrame:
    """Encodes docs (doc_id, text; other columns are ignored) and writes segments in ascending doc_id order; returns the table.

    Null and empty texts are documents of the end id alone. A null doc_id sorts first. Rows that
    repeat a doc_id are documents each, in the order of their texts. Documents are dealt by ranges
    of doc_id, so a part holds a run of ids and the order of (part, seg) is that of doc_id.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, part, seg = encoder(tokenizer), 0, 0
        end = np.array([END_ID], "<u4").tobytes()
        names, encoded, sizes, total = [], [], [0], 0

        def flush():
            ids = np.frombuffer(b"".join(encoded), "<u4")
            row = [[part], [seg], [names], [len(ids)], [pack(ids, np.array(sizes))]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, ARROW.types)], schema=ARROW)

        for batch in batches:
            part = batch.column(2)[0].as_py() if batch.num_rows else part
            for name, ids in zip(batch.column(0).to_pylist(), code.encode_all(batch.column(1))):
                n = len(ids) // 4 + 1
                if encoded and total + n > segment_ids:
                    yield flush()
                    names, encoded, sizes, total, seg = [], [], [0], 0, seg + 1
                names.append(name)
                encoded += [ids, end]
                total += n
                sizes.append(total)
        if encoded:
            yield flush()

    dealt = texts(docs)
    dealt = dealt.repartitionByRange(partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    return written(dealt.withColumn("part", F.spark_partition_id()).mapInArrow(encode, SEGMENTS), "tokens")


ARROW = pa.schema([("part", pa.int32()), ("seg", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.int64()), ("codes", pa.binary())])


def read_tokens(segments: DataFrame) -> DataFrame:
    """Reads segments back: one row per document with start (ids of all documents before it), n_tokens and ids_crc32.

    Starts are prefix sums in two steps: over the parts (a row for each), then within a part.
    """
    sizes = segments.select("part", "seg", "n_tokens")
    per_part = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before_part = per_part.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))
    in_part = Window.partitionBy("part").orderBy("seg")
    starts = sizes.select("part", "seg", (F.sum("n_tokens").over(in_part) - F.col("n_tokens")).alias("seg_start"))
    starts = starts.join(before_part, "part").select("part", "seg", (F.col("part_start") + F.col("seg_start")).alias("start"))
    small = segments.select("part", "seg", "doc_ids", "codes").mapInArrow(digest, "part int, seg int, doc_id bigint, place bigint, n_tokens bigint, ids_crc32 bigint")
    return small.join(starts, ["part", "seg"]).select("doc_id", (F.col("start") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")


def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, seg, names, codes in zip(*(batch.column(i) for i in range(4))):
            seg_reader = Segment(codes.as_py())
            raw, at = memoryview(seg_reader.ids().astype("<u4").tobytes()), seg_reader.offsets.astype(np.int64)
            n = seg_reader.documents
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array([part.as_py()] * n, pa.int32()), pa.array([seg.as_py()] * n, pa.int32()), pa.array(names.as_py(), pa.int64()), pa.array(at[:-1]), pa.array(np.diff(at)), pa.array(crc, pa.int64())],
                names=["part", "seg", "doc_id", "place", "n_tokens", "ids_crc32"],
            )
