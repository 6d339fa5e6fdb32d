"""Level-wise doubling over repeated runs of words.

Level 1 looks at runs of half the window's length. Not every run is sent: of any window the
half-length run with the least hash is its anchor (winnowing), so two equal windows have equal
anchors at the same place in them. Anchors that only one document has end there: no window around
them repeats. Only windows whose anchor survives are hashed at the doubled length, and only
those that start in several documents survive that level. longest_repeats goes on: windows that
survive are doubled again, and again, until none do.

Groups are never gathered: a level needs the least and greatest doc_id per hash, an aggregate with
map-side combine, and a join back that adaptive execution splits where one hash is very common.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, texts, written
from .wordhash import hashes_of, run_hashes

WINDOW = 50
PASS_1 = "doc_id bigint, sha string, n_words bigint, anchors array<bigint>"
PASS_2 = "doc_id bigint, text string, hashes array<bigint>"
OUT = "doc_id bigint, sha string, n_removed bigint, kept_sha256 string"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def digest_of(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def anchors_of(w: np.ndarray, window: int) -> np.ndarray:
    """For each window, where its anchor starts."""
    half = run_hashes(w, window // 2)
    span = window - window // 2 + 1
    if len(half) < span:
        return np.zeros(0, np.int64)
    # least of span hashes, by doubling; ties: the first
    least, place, have = half.copy(), np.arange(len(half)), 1
    n = len(half)
    while have < span:
        step = min(have, span - have)
        a, b = least[: n - step], least[step:n]
        take = b < a
        least, place = np.where(take, b, a), np.where(take, place[step:n], place[: n - step])
        n -= step
        have += step
    return place


def _long(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    flat = np.concatenate(values) if values else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(kind.to_pandas_dtype()), kind))


def _anchors(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sha, n, anchors = [], [], []
            for text in batch.column(1):
                words = words_of(text.as_py())
                w = hashes_of(words)
                sha.append(digest_of(words))
                n.append(len(words))
                half = run_hashes(w, window // 2)
                anchors.append(_long(np.unique(half[np.unique(anchors_of(w, window))])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sha, pa.string()), pa.array(n, pa.int64()), _lists(anchors, pa.int64())], names=["doc_id", "sha", "n_words", "anchors"])

    return run


def _windows(window: int):
    """Distinct hashes of the windows whose anchor is among the repeated ones. Rows that share a doc_id share these, so one may send a window that only the other's anchors let through: it is compared like any other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = []
            for text, repeated in zip(batch.column(1), batch.column(2)):
                w = hashes_of(words_of(text.as_py()))
                anchor = _long(run_hashes(w, window // 2))[anchors_of(w, window)]
                at = np.isin(anchor, repeated.values.to_numpy(zero_copy_only=False))
                hashes.append(_long(np.unique(run_hashes(w, window)[at])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _lists(hashes, pa.int64())], names=["doc_id", "text", "hashes"])

    return run


def _remove(window: int):
    """What is left of texts without the windows of the given hashes, wherever they stand in the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sha, removed, kept = [], [], []
            for text, gone in zip(batch.column(1), batch.column(2)):
                words = words_of(text.as_py())
                edges = np.zeros(len(words) + 1, np.int64)
                starts = np.flatnonzero(np.isin(_long(run_hashes(hashes_of(words), window)), gone.values.to_numpy(zero_copy_only=False)))
                edges[starts] += 1
                edges[starts + window] -= 1
                covered = np.cumsum(edges[:-1]) > 0
                sha.append(digest_of(words))
                removed.append(int(covered.sum()))
                kept.append(digest_of([words[i] for i in np.flatnonzero(~covered).tolist()]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sha, pa.string()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "sha", "n_removed", "kept_sha256"])

    return run


def repeated(rows: DataFrame, key: str) -> DataFrame:
    """Keys that start in several documents, with the least doc_id."""
    ends = rows.groupBy(key).agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
    return ends.where("first_doc < last_doc").select(key, "first_doc")


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256, with words covered by a window that also starts in a document with a smaller doc_id removed.

    Null texts have no words; texts under window words lose none. A null doc_id is in no order: its
    row keeps all words and removes none elsewhere. Rows that repeat a doc_id are judged each by
    itself, and a window in both is no repeat. Other columns are dropped. Runs are compared by
    64-bit hashes of words.
    """
    spark = docs.sparkSession
    docs = texts(docs)
    first = written(docs.mapInArrow(_anchors(window), PASS_1), "anchors")
    each = first.where("doc_id is not null").select("doc_id", F.explode("anchors").alias("anchor"))
    hits = written(each.join(repeated(each, "anchor"), "anchor").groupBy("doc_id").agg(F.collect_set("anchor").alias("repeated")), "hits", 2)
    release(spark)
    # texts of documents with surviving anchors
    second = written(docs.join(hits, "doc_id").select("doc_id", "text", "repeated").mapInArrow(_windows(window), PASS_2), "windows", 2)
    release(spark, hits)
    each = second.select("doc_id", F.explode("hashes").alias("hash"))
    gone = each.join(repeated(each, "hash"), "hash").where("doc_id > first_doc")
    gone = written(gone.groupBy("doc_id").agg(F.collect_set("hash").alias("gone")), "gone", 1)
    release(spark)
    cut = gone.join(second.select("doc_id", "text"), "doc_id").select("doc_id", "text", "gone")
    cut = cut.mapInArrow(_remove(window), OUT).dropDuplicates(["doc_id", "sha"])
    return (
        first.select("doc_id", "sha", "n_words")
        .join(cut, ["doc_id", "sha"], "left")
        .select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"))
    )


def longest_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Levels of the doubling: rows (length, doc_id, n_windows) for window, 2 * window, and so on until no candidate survives.

    n_windows is how many distinct windows of that length in the document start in another one too.
    At each level only places whose two halves both repeat are hashed; a document's surviving
    hashes travel with its text to the next. Null texts and null doc_ids have no windows.
    """
    docs = texts(docs).where("doc_id is not null")
    alive = docs.select("doc_id", "text", F.lit(None).cast("array<bigint>").alias("hashes"))
    length, levels = window, None
    while True:

        def run(batches: Iterator[pa.RecordBatch], length=length, first=levels is None) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = []
                for text, halves in zip(batch.column(1), batch.column(2)):
                    w = hashes_of(words_of(text.as_py()))
                    whole = run_hashes(w, length)
                    if not first:
                        half = np.isin(_long(run_hashes(w, length // 2)), halves.values.to_numpy(zero_copy_only=False))
                        whole = whole[half[: len(whole)] & half[length // 2 : length // 2 + len(whole)]]
                    found.append(_long(np.unique(whole)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _lists(found, pa.int64())], names=["doc_id", "text", "hashes"])

        level = written(alive.mapInArrow(run, PASS_2), "level")
        each = level.select("doc_id", F.explode("hashes").alias("hash")).distinct()
        hits = written(each.join(repeated(each, "hash").select("hash"), "hash").groupBy("doc_id").agg(F.collect_set("hash").alias("hashes")), "alive", 2)
        if hits.isEmpty():
            return levels if levels is not None else hits.select(F.lit(length).alias("length"), "doc_id", F.size("hashes").alias("n_windows"))
        rows = hits.select(F.lit(length).alias("length"), "doc_id", F.size("hashes").alias("n_windows"))
        levels = rows if levels is None else levels.union(rows)
        alive = hits.join(level.select("doc_id", "text"), "doc_id").select("doc_id", "text", "hashes")
        length *= 2
