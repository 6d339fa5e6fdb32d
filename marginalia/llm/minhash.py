"""Near-duplicate groups by b-bit MinHash.

A document's set is its distinct five-word shingles (64-bit hashes). From K minima come band keys
(ROWS minima each), which propose candidates, and a packed signature of the low BITS bits of every
minimum. Equal low bits also come by chance, 1 in 2**BITS, so similarity is estimated from the
count of agreeing positions, corrected for that; the count is a few bit operations on longs.
Candidates whose estimate is clearly below the threshold go; the others are confirmed on full sets.

Copies (equal sets) are one node. Within a bucket of documents with one band key no two members
are paired as such. First every member meets one pivot, the member that shares most buckets with
others (the middle of its group), which is linear in the bucket. After these links are confirmed,
most buckets are one component, and need nothing more: links inside a component change nothing.
Families (documents tied by buckets, linked or not) that hold several components are the rest: in
each, the members outside its largest component meet all members of other components, in pairs of
blocks of bounded size, through the signature and then full sets. Only links leave a block, so no
link that a band proposes is lost and no rows of failed pairs are made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import caches
from .common import components, fresh, release, texts, written
from .wordhash import hashes, hashes_of, mix, run_hashes

WORDS, PERCENT = 5, 75
K, ROWS, BITS = 128, 4, 4
#: Four standard errors of the estimate at the threshold.
MARGIN = 0.16
SKETCH = "doc_id bigint, n_shingles bigint, digest string, signature array<bigint>, bands array<bigint>"
SETS = "doc_id bigint, shingles array<bigint>"
_random = np.random.default_rng(20240501)
_MUL = (_random.integers(0, 1 << 32, K, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_XOR = _random.integers(0, 1 << 32, K, dtype=np.uint64).astype(np.uint32)
#: Low bit of each position of a packed long.
_ONES = sum(1 << i for i in range(0, 64, BITS))
#: Shingles hashed at once, and documents of a block.
_BLOCK, BLOCK = 1 << 18, 64


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes; the whole sequence as one if there are fewer words; none without words."""
    words = (text or "").encode().lower().split()  # bytes: A-Z alone change
    if not words:
        return np.zeros(0, np.uint64)
    return np.unique(run_hashes(hashes_of(words), min(WORDS, len(words))))


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """K minima of each non-empty set."""
    out = np.full((len(sets), K), 0xFFFFFFFF, np.uint32)
    at = 0
    while at < len(sets):
        to, size = at, 0
        while to < len(sets) and (to == at or size + len(sets[to]) <= _BLOCK):
            size += len(sets[to])
            to += 1
        flat = np.concatenate(sets[at:to]).astype(np.uint32)
        starts = np.cumsum([0, *(len(s) for s in sets[at : to - 1])])
        if len(flat):
            for k in range(K):
                out[at:to, k] = np.minimum.reduceat((flat ^ _XOR[k]) * _MUL[k], starts)
        at = to
    return out


def packed(m: np.ndarray) -> np.ndarray:
    """The low BITS bits of each minimum (after its halves are folded), 64 // BITS to a long."""
    low = ((m ^ (m >> np.uint32(16))) & np.uint32((1 << BITS) - 1)).astype(np.uint64)
    per = 64 // BITS
    shifts = (np.arange(per, dtype=np.uint64) * np.uint64(BITS))[None, None, :]
    return (low.reshape(len(m), K // per, per) << shifts).sum(axis=2, dtype=np.uint64).view(np.int64)


def band_keys(m: np.ndarray) -> np.ndarray:
    rows = m.reshape(len(m), K // ROWS, ROWS).astype(np.uint64)
    key = np.arange(K // ROWS, dtype=np.uint64)[None, :] * np.ones((len(m), 1), np.uint64)
    for r in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, r])
    return key.view(np.int64)


def _fixed(rows: np.ndarray, present: np.ndarray) -> pa.Array:
    """Lists of equal length, none where absent."""
    counts = np.where(present, rows.shape[1], 0)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(rows[present].ravel()))


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    caches.use(hashes)
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            sets = [shingles(t.as_py()) for t in part.column(1)]
            there = np.array([len(s) > 0 for s in sets], bool)
            m = np.full((len(sets), K), 0, np.uint32)
            if there.any():
                m[there] = minima([s for s in sets if len(s)])
            digest = [xxhash.xxh3_128_hexdigest(s.tobytes()) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.string()), _fixed(packed(m), there), _fixed(band_keys(m), there)],
                names=["doc_id", "n_shingles", "digest", "signature", "bands"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    caches.use(hashes)
    for batch in batches:
        sets = [np.zeros(0, np.int64), *[shingles(t.as_py()).view(np.int64) for t in batch.column(1)]]
        offsets = np.cumsum([len(s) for s in sets]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets)))], names=["doc_id", "shingles"])


def agreeing(a: str, b: str) -> Column:
    """Positions with equal low bits in two packed signatures (array columns)."""
    ones = _ONES - (1 << 64 if _ONES >= 1 << 63 else 0)
    differ = F.lit(0)
    for i in range(K * BITS // 64):
        x = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        step = 1
        while step < BITS:
            x = x.bitwiseOR(F.shiftrightunsigned(x, step))
            step *= 2
        differ = differ + F.bit_count(x.bitwiseAND(F.lit(ones)))
    return F.lit(K) - differ


def least_agreement() -> float:
    """Agreeing positions expected at MARGIN under the threshold, with chance agreement."""
    chance = 0.5**BITS
    return K * (chance + (1 - chance) * (PERCENT / 100 - MARGIN))


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) whose full sets are similar enough."""
    left = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("of_b")), "b")
    both = left.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("of_a")), "a")
    shared = F.size(F.array_intersect("of_a", "of_b"))
    return both.where(100 * shared >= PERCENT * (F.size("of_a") + F.size("of_b") - shared)).select("a", "b").distinct()


LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _across(group: pa.Table) -> pa.Table:
    """Links between members of a block pair that are in different components; sides 0 and 1, or one side alone."""
    group = group.combine_chunks()
    ids, comp, side = (group.column(c).to_numpy() for c in ("node", "component", "side"))
    lists = lambda name: group.column(name).chunk(0)
    left, right = [], []
    if len(ids) > 1:
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        a, b = (a, b) if len(a) and len(b) else (np.arange(len(ids)),) * 2
        sig = lists("signature").flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(len(ids), -1)
        ends, flat = np.concatenate([[0], np.cumsum(pc.list_value_length(lists("shingles")).to_numpy(zero_copy_only=False))]), lists("shingles").flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        agree = np.zeros((len(a), len(b)), np.int64)
        for k in range(sig.shape[1]):
            x, step = sig[a, k][:, None] ^ sig[b, k][None, :], 1
            while step < BITS:
                x |= x >> np.uint64(step)
                step *= 2
            agree += 64 // BITS - np.bitwise_count(x & np.uint64(_ONES)).astype(np.int64)
        size = np.diff(ends)
        near = (agree >= least_agreement()) & (comp[a][:, None] != comp[b][None, :])
        near &= 100 * np.minimum(size[a][:, None], size[b][None, :]) >= PERCENT * np.maximum(size[a][:, None], size[b][None, :])
        for p, q in zip(*(n.tolist() for n in np.nonzero(near))):
            x, y = a[p], b[q]
            both = np.concatenate([flat[ends[x] : ends[x + 1]], flat[ends[y] : ends[y + 1]]])
            both.sort()
            shared = int((both[1:] == both[:-1]).sum())
            if 100 * shared >= PERCENT * (len(both) - shared):
                left.append(min(ids[x], ids[y]))
                right.append(max(ids[x], ids[y]))
    return pa.table([pa.array(left, pa.int64()), pa.array(right, pa.int64())], schema=LINKS)


def rest_links(families: DataFrame, found: DataFrame, hubs: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between components of a family, other than those inside its largest component.

    A block pair is a group of its own, sorted by Spark and handed to Python by itself, so memory
    holds one: about 2 * BLOCK sets.
    """
    placed = families.select(F.col("id").alias("node"), F.col("component").alias("family")).join(found.withColumnRenamed("id", "node"), "node", "left")
    placed = placed.withColumn("component", F.coalesce("component", "node"))
    per = placed.groupBy("family", "component").agg(F.count("*").alias("n"))
    per = per.groupBy("family").agg(F.max(F.struct("n", -F.col("component"))).alias("top"), F.sum("n").alias("total"))
    per = per.where("total > top.n").select("family", (-F.col("top.col2")).alias("main"), F.ceil(F.col("top.n") / BLOCK).cast("int").alias("main_blocks"), F.ceil((F.col("total") - F.col("top.n")) / BLOCK).cast("int").alias("rest_blocks"))
    rows = placed.join(per, "family").withColumn("rest", F.col("component") != F.col("main"))
    own = F.pmod(F.xxhash64("node"), F.when(F.col("rest"), F.col("rest_blocks")).otherwise(F.col("main_blocks"))).cast("int")
    rows = rows.withColumn("own", own).join(hubs.select("node", "signature"), "node").join(sets.select(F.col("doc_id").alias("node"), "shingles"), "node")
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    place = lambda i, j, main, side: F.struct(i.alias("i"), j.alias("j"), F.lit(main).alias("main"), side.cast("int").alias("side"))
    own = F.col("own")
    with_rest = F.transform(upto(F.col("rest_blocks")), lambda k: place(F.least(own, k), F.greatest(own, k), False, own > k))
    with_main = F.transform(upto(F.col("main_blocks")), lambda k: place(own, k, True, F.lit(0)))
    of_main = F.transform(upto(F.col("rest_blocks")), lambda k: place(k, own, True, F.lit(1)))
    rows = rows.withColumn("at", F.explode(F.when(F.col("rest"), F.concat(with_rest, with_main)).otherwise(of_main)))
    rows = rows.select("family", "at.main", "at.i", "at.j", "at.side", "node", "component", "signature", "shingles")
    return rows.groupBy("family", "main", "i", "j").applyInArrow(_across, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest doc_id reachable by links), kept (doc_id = component_id).

    Null, empty and blank texts have no shingles and stand alone. A null doc_id stands alone too,
    with a null component, and is kept. Rows that repeat a doc_id are one node, whose links are
    those of any of its texts. Other columns are dropped. A link is found if the two texts agree in
    a band: at the threshold that fails for one pair in 200,000, rarer above it.
    """
    spark = docs.sparkSession
    docs = texts(docs)
    sketches = written(docs.mapInArrow(_sketch, SKETCH), "sketches")
    known = sketches.where("doc_id is not null and n_shingles > 0")
    classes = known.groupBy("digest").agg(F.min("doc_id").alias("node"))
    nodes = known.join(classes, ["digest"]).where("doc_id = node").select("node", "signature", "bands").dropDuplicates(["node", "signature"])
    nodes = written(nodes, "nodes", 2)
    crowded = nodes.select(F.explode("bands").alias("key")).groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = written(nodes.select("node", F.explode("bands").alias("key")).join(crowded, "key"), "members", 2)
    hubs = members.groupBy("node").agg(F.sum("n").alias("hub")).join(nodes.select("node", "signature"), "node")
    hubs = written(hubs, "hubs", 1)  # a row for each signature of a node: an id that repeats may be the least of several classes
    release(spark, nodes)
    ranked = members.select("key", "node").join(hubs.select("node", "hub"), "node")
    pivots = ranked.groupBy("key").agg(F.max(F.struct("hub", -F.col("node"))).alias("top")).select("key", (-F.col("top.col2")).alias("pivot"))
    met = members.select("key", "node").join(pivots, "key").where("node <> pivot")
    met = met.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
    met = met.join(hubs.select(F.col("node").alias("a"), F.col("signature").alias("sig_a")), "a")
    met = met.join(hubs.select(F.col("node").alias("b"), F.col("signature").alias("sig_b")), "b")
    met = written(met.select("a", "b", (agreeing("sig_a", "sig_b") >= least_agreement()).alias("near")).distinct(), "met", 1)
    release(spark, members)
    # a merge at every size: the documents that met others grow with the input
    sets = docs.join(hubs.select(F.col("node").alias("doc_id")).hint("merge"), "doc_id", "left_semi")
    sets = written(sets.mapInArrow(_sets, SETS), "sets", 2)
    links = confirmed(met.where("near").select("a", "b").distinct(), sets)
    # both graphs at once: families by what met, components by what is linked
    both = met.select(F.lit(0).alias("graph"), "a", "b").union(links.select(F.lit(1).alias("graph"), "a", "b"))
    of_both = components(both, graph="graph")
    release(spark, met)
    families, found = of_both.where("g = 0").drop("g"), of_both.where("g = 1").drop("g")
    more = written(rest_links(families, found, hubs, sets), "links", 1)
    release(spark, sets, hubs)
    if not more.isEmpty():
        found = joined(found, more)
    placed = known.select("digest", "doc_id").join(classes, "digest").join(found.withColumnRenamed("id", "node"), "node", "left")
    of_row = one_component(written(placed.select("doc_id", F.coalesce("component", "node").alias("component")), "placed", 2))
    out = sketches.select("doc_id", "n_shingles").join(of_row, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_component(placed: DataFrame) -> DataFrame:
    """(doc_id, component_id) from rows (doc_id, component): an id of texts in several components joins these."""
    ends = placed.groupBy("doc_id").agg(F.min("component").alias("least"), F.max("component").alias("most"))
    several = ends.where("least < most").select("doc_id", "least")
    if several.isEmpty():
        return ends.select("doc_id", F.col("least").alias("component_id"))
    moved = components(placed.join(several, "doc_id").where("component <> least").select(F.col("component").alias("a"), F.col("least").alias("b")))
    moved = moved.select(F.col("id").alias("least"), F.col("component").alias("to"))
    return ends.join(moved, "least", "left").select("doc_id", F.coalesce("to", "least").alias("component_id"))


def joined(found: DataFrame, more: DataFrame) -> DataFrame:
    """Components (id, component) with the links (a, b) added: only components are joined, not their members anew."""
    of = lambda end: found.select(F.col("id").alias(end), F.col("component").alias(f"of_{end}"))
    ends = more.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    moved = written(components(ends).select(F.col("id").alias("component"), F.col("component").alias("to")), "components", 1)
    alone = moved.select(F.col("component").alias("id"), F.col("to").alias("component")).join(found.select("id"), "id", "left_anti")
    return found.join(moved, "component", "left").select("id", F.coalesce("to", "component").alias("component")).union(alone)


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that are the kept ones of their group; rows that repeat a kept doc_id stay."""
    gone = fresh(docs, "gone_id")
    out = near_duplicates(docs).where("not kept").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(out, docs["doc_id"] == F.col(gone), "left_anti")
