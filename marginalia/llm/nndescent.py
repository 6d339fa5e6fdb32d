"""Near-duplicate embeddings by NN-descent.

Every vector keeps a list of near neighbours of its label. The lists begin from random-hyperplane
cells and are refined: vectors that meet in the lists of a common neighbour are compared, and the
nearest stay. A list whose entries are all above the threshold is saturated and may double at each
round. Recall is audited against brute force for a bounded sample of vectors, and while it is
short, new cells are drawn and the lists refined again. Pairs above the threshold are links.

Links make components. Inside a component all pairs are counted exactly, block against block, so
link counts do not depend on how long the lists grew: the lists only have to connect. Equal
directions of a label are one node with a multiplicity; groups of a cell are dealt to blocks of
bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let
from .common import components, release, written

THRESHOLD = 0.93
NEIGHBOURS, TABLES, CELL, CHUNK, BLOCK = 8, 6, 128, 64, 256
ROUNDS, TRIES, QUIET = 3, 10, 0.02
#: Vectors of the recall audit, and the recall that ends it.
AUDIT, RECALL = 512, 0.995
#: Single precision decides outside this distance from the threshold, double within.
CLOSE = 1e-4
PAIRS = "u bigint, v bigint, sim float"


def _matrix(column: pa.Array, at: int, kind=np.float32) -> np.ndarray:
    """The vectors of one row of a list of lists."""
    vectors = column.slice(at, 1).flatten()
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(vectors), -1)


def _nearest(limit: int):
    """Rows (ids, vectors): for each vector the limit nearest others of its row, and those above the threshold up to twice that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us, vs, sims = [], [], []
            for i in range(batch.num_rows):
                ids = batch.column(0).slice(i, 1).flatten().to_numpy(zero_copy_only=False)
                if len(ids) < 2:
                    continue
                x = _matrix(batch.column(1), i)
                sim = x @ x.T
                np.fill_diagonal(sim, -2)
                sim[ids[:, None] == ids[None, :]] = -2
                k = min(limit, len(ids) - 1)
                top = np.argpartition(-sim, k - 1, axis=1)[:, :k]
                of = np.repeat(np.arange(len(ids)), k)
                near = top.ravel()
                value = sim[of, near]
                good = value > -2
                us.append(ids[of[good]])
                vs.append(ids[near[good]])
                sims.append(value[good])
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs)), pa.array(np.concatenate(sims).astype(np.float32))], names=["u", "v", "sim"])

    return run


def _by_length(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Places and matrix of the vectors of each length."""
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    out = []
    for size in np.unique(sizes):
        own = np.flatnonzero(sizes == size)
        out.append((own, column.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).reshape(len(own), size)))
    return out


def _cells(tables: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            bits = batch.column(3).to_numpy(zero_copy_only=False)
            most = int(bits.max(initial=0))
            codes = np.zeros((batch.num_rows, tables), np.int64)
            for own, x in _by_length(batch.column(2)):
                dim = x.shape[1]
                if (dim, most) not in planes:
                    planes[dim, most] = np.random.default_rng(seed).normal(size=(64, tables, dim)).astype(np.float32)[:most]
                for k in range(most):
                    codes[own] |= (x.astype(np.float32) @ planes[dim, most][k].T > 0).astype(np.int64) << k
            codes &= (1 << bits[:, None].astype(np.int64)) - 1  # as many planes as the label's size asks for
            cells = pa.ListArray.from_arrays(pa.array((np.arange(len(codes) + 1) * tables).astype(np.int32)), pa.array(codes.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), cells], names=["node", "label", "vector", "cells"])

    return run


def dealt(rows: DataFrame, keys: list[str], size: int) -> DataFrame:
    """rows with a column `part` that deals each group of keys to parts of about size rows."""
    counts = rows.groupBy(*keys).agg(F.count("*").alias("in_group")).where("in_group > 1")
    out = rows.join(counts, keys)
    return out.withColumn("part", F.pmod(F.xxhash64("node", *keys), F.ceil(F.col("in_group") / size)).cast("int")).drop("in_group")


def compared(rows: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """Nearest pairs within each group of keys; groups are of bounded size."""
    groups = rows.groupBy(*keys).agg(F.collect_list(F.struct("node", "vector")).alias("m"))
    return groups.select(F.col("m.node").alias("ids"), F.col("m.vector").alias("vectors")).mapInArrow(_nearest(limit), PAIRS)


def by_cells(nodes: DataFrame, sizes: DataFrame, seed: int) -> DataFrame:
    """Nearest pairs in random cells, of about CELL vectors each by the size of their own label."""
    bits = F.greatest(F.lit(0), F.least(F.lit(62), F.ceil(F.log2(F.col("size") / CELL)))).cast("int")
    rows = nodes.join(sizes.select("label", bits.alias("bits")), "label").select("node", "label", "vector", "bits")
    rows = rows.mapInArrow(_cells(TABLES, seed), "node bigint, label string, vector array<float>, cells array<bigint>")
    rows = rows.select("node", "label", "vector", F.posexplode("cells").alias("table", "cell"))
    keys = ["table", "label", "cell"]
    return compared(dealt(rows, keys, CELL), [*keys, "part"], NEIGHBOURS)


def by_neighbours(lists: DataFrame, nodes: DataFrame, round_: int) -> DataFrame:
    """Neighbours of a common neighbour, out and in."""
    both = lists.select(F.col("u").alias("centre"), F.col("v").alias("node")).union(lists.select(F.col("v").alias("centre"), F.col("u").alias("node")))
    both = both.union(lists.select(F.col("u").alias("centre"), F.col("u").alias("node"))).distinct()
    parts = dealt(both, ["centre"], CHUNK).join(nodes.select("node", "vector"), "node")
    return compared(parts, ["centre", "part"], NEIGHBOURS << round_)


def merged(old: DataFrame | None, new: DataFrame, growth: int, threshold: float) -> DataFrame:
    """The NEIGHBOURS nearest of each list, more of them if saturated; was is 0 for new entries."""
    rows = new.withColumn("was", F.lit(0))
    if old is not None:
        rows = rows.unionByName(old.select("u", "v", "sim").withColumn("was", F.lit(1)))
    rows = rows.groupBy("u", "v").agg(F.max("sim").alias("sim"), F.max("was").alias("was"))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("u").orderBy(F.desc("sim"), "v")))
    kept = (F.col("rank") <= NEIGHBOURS) | ((F.col("sim") >= threshold) & (F.col("rank") <= NEIGHBOURS << growth))
    return written(rows.where(kept).select("u", "v", "sim", "was"), "lists", 2)


def link_edges(lists: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Pairs of the lists with cosine at the threshold or above, close ones decided in double precision."""
    pairs = lists.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"), "sim").where(F.col("sim") >= threshold - CLOSE).groupBy("a", "b").agg(F.max("sim").alias("sim"))
    sure = pairs.where(F.col("sim") >= threshold + CLOSE).select("a", "b")
    close = pairs.where(F.col("sim") < threshold + CLOSE)
    close = close.join(nodes.select(F.col("node").alias("a"), F.col("unit").alias("x")), "a").join(nodes.select(F.col("node").alias("b"), F.col("unit").alias("y")), "b")
    dot = F.aggregate(F.zip_with("x", "y", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return sure.union(close.where(dot >= threshold).select("a", "b"))


def audited(nodes: DataFrame, found: DataFrame, threshold: float) -> float:
    """Mean over the sample's vectors with links of the share of these whose ends are in one component; the sample is AUDIT vectors against all. By vector, so one large cluster hides no lost pairs."""
    sample = nodes.orderBy(F.xxhash64("node"), "node").limit(AUDIT).select("node", "label", "unit").collect()
    if not sample:
        return 1.0
    queries = {}
    for r in sample:
        queries.setdefault(len(r["unit"]), []).append(r)
    queries = {n: (np.array([r["unit"] for r in rows]), np.array([r["node"] for r in rows]), np.array([r["label"] for r in rows])) for n, rows in queries.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, label = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for own, x in _by_length(batch.column(2)):
                if x.shape[1] in queries:
                    q, names, labels = queries[x.shape[1]]
                    i, j = np.nonzero((q @ x.T >= threshold) & (labels[:, None] == label[own][None, :]) & (names[:, None] != node[own][None, :]))
                    yield pa.RecordBatch.from_arrays([pa.array(names[i]), pa.array(node[own][j])], names=["q", "node"])

    true = nodes.select("node", "label", "unit").mapInArrow(run, "q bigint, node bigint")
    true = true.join(found.withColumnRenamed("id", "q").withColumnRenamed("component", "of_q"), "q", "left").join(found.withColumnRenamed("id", "node"), "node", "left")
    by_vector = true.groupBy("q").agg((F.count_if(F.col("of_q") == F.col("component")) / F.count("*")).alias("share"))
    return by_vector.agg(F.coalesce(F.avg("share"), F.lit(1.0))).first()[0]


def _counts(threshold: float):
    """Rows of a component's block pair: each vector's links in the other block, weighted with multiplicities; and the links of marked vectors one by one (other)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, links, others = [], [], []
            for i in range(batch.num_rows):
                lo, hi = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                ids, block, n, marked = (batch.column(c).slice(i, 1).flatten().to_numpy(zero_copy_only=False) for c in (2, 3, 4, 5))
                x = _matrix(batch.column(6), i, np.float64)
                hit = x @ x.T >= threshold
                if lo != hi:
                    hit &= block[:, None] != block[None, :]
                np.fill_diagonal(hit, False)
                marked = marked.astype(bool)
                a, b = np.nonzero(hit & (marked[:, None] | marked[None, :])) if marked.any() else (np.zeros(0, np.int64),) * 2
                nodes += [ids, ids[a]]
                links += [hit @ n, np.zeros(len(a), np.int64)]
                others += [np.full(len(ids), -1), ids[b]]
            if nodes:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in (nodes, links, others)], names=["node", "links", "other"])

    return run


def counted(nodes: DataFrame, found: DataFrame, threshold: float) -> DataFrame:
    """node, links, other: over all pairs of each component, in blocks of about BLOCK. other is -1, or a vector that node is linked to where one of the two is marked (links is 0 then)."""
    rows = nodes.select("node", "n", "marked", "unit").join(found.withColumnRenamed("id", "node"), "node")
    sizes = rows.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    rows = rows.join(sizes, "component").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    groups = rows.groupBy("component", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi")).agg(F.collect_list(F.struct("node", "block", "n", "marked", "unit")).alias("m"))
    return groups.select("lo", "hi", "m.node", "m.block", "m.n", "m.marked", "m.unit").mapInArrow(_counts(threshold), "node bigint, links bigint, other bigint")


def _blocks(threshold: float):
    """Rows of a label's block pair: for each vector the least vector of the other block it is linked to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids = batch.column(0).slice(i, 1).flatten().to_numpy(zero_copy_only=False)
                x = _matrix(batch.column(1), i, np.float64)
                hit = x @ x.T >= threshold
                np.fill_diagonal(hit, False)
                least = np.where(hit, ids[None, :], np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max)
                own = hit.any(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(least[own])], names=["a", "b"])

    return run


def exact_edges(nodes: DataFrame, threshold: float) -> DataFrame:
    """Edges (a, b) with the components of all links: block against block within each label, a vector's least partner of each block pair."""
    sizes = nodes.groupBy("label").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    rows = nodes.select("node", "label", "unit").join(sizes, "label").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    groups = rows.groupBy("label", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi")).agg(F.collect_list(F.struct("node", "unit")).alias("m"))
    return groups.select("m.node", "m.unit").mapInArrow(_blocks(threshold), "a bigint, b bigint")


def linked_ids(members: DataFrame, nodes: DataFrame, counts: DataFrame) -> DataFrame:
    """vec_id, n_links: the distinct other ids linked to any vector of an id.

    members: rows (vec_id, node, several), several if the id has several vectors, whose nodes are
    marked. Where no id is linked in two ways, that is a sum over nodes; marked nodes alone are
    taken link by link, so that an id met through several vectors counts once.
    """
    sums = counts.where("other < 0").groupBy("node").agg(F.sum("links").alias("links"))
    by_node = nodes.select("node", "n", "marked").join(sums, "node", "left").select("node", (F.col("n") + F.coalesce("links", F.lit(0))).alias("met"))
    plain = members.where("not several").join(by_node, "node")
    several = members.where("several")
    if several.isEmpty():
        return plain.select("vec_id", (F.col("met") - 1).alias("n_links"))
    pairs = counts.where("other >= 0").select("node", "other").union(nodes.where("marked").select("node", F.col("node").alias("other")))
    pairs = written(pairs, "marked", 2)
    of_marked = several.select(F.col("node").alias("other"), F.col("vec_id").alias("met_id"))
    # ids with one vector: what several of a node's partners share counts once
    twice = pairs.join(of_marked, "other").groupBy("node", "met_id").agg(F.count("*").alias("k")).groupBy("node").agg(F.sum(F.col("k") - 1).alias("extra"))
    ones = plain.join(twice, "node", "left").select("vec_id", (F.col("met") - 1 - F.coalesce("extra", F.lit(0))).alias("n_links"))
    # ids with several: all nodes they reach, once each
    reached = several.select("vec_id", "node").join(pairs, "node").select("vec_id", "other").distinct()
    total = reached.join(nodes.select(F.col("node").alias("other"), "n"), "other").groupBy("vec_id").agg(F.sum("n").alias("met"))
    extra = reached.join(of_marked, "other").groupBy("vec_id", "met_id").agg(F.count("*").alias("k")).groupBy("vec_id").agg(F.sum(F.col("k") - 1).alias("extra"))
    many = total.join(extra, "vec_id", "left").select("vec_id", (F.col("met") - 1 - F.coalesce("extra", F.lit(0))).alias("n_links"))
    return ones.union(many)


def _unit(e: Column) -> Column:
    """e of length 1. Scaled by its largest component first, lest squares overflow or vanish; each step is made once for a vector."""
    scaled = let(F.array_max(F.transform(e, F.abs)), lambda top: F.transform(e, lambda x: x / top))
    length = lambda s: F.sqrt(F.aggregate(s, F.lit(0.0), lambda n, x: n + x * x))
    return let(scaled, lambda s: let(length(s), lambda n: F.transform(s, lambda x: x / n + 0.0)))


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, log: list | None = None) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept (vec_id = component_id).

    Vectors that are null or zero or hold null or non-finite components and vectors without a label
    stand alone, with no links; vectors of several lengths link with those of their own only. A
    null vec_id stands alone with a null component and is kept. Rows that repeat a vec_id are one
    vector, or with other contents several vectors of that id: it is linked to whatever one of
    them is, n_links counts distinct other ids, and the components they are in are one. Ties in
    similarity go to the smaller node of the lists and decide no link. An empty table gives an
    empty one. Other columns are dropped. log, if given, gets the audited recall of each try. If
    no try reaches RECALL, all vectors of a label are compared in blocks.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    fine = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("embedding", lambda x: x != 0)
    usable = rows.where(fine).select("vec_id", F.concat_ws(":", "label", F.size("embedding")).alias("label"), _unit(F.col("embedding")).alias("unit"))
    # nodes get numbers when they are written, and keep them from then on
    nodes = written(usable.select("label", "unit").distinct().select(F.monotonically_increasing_id().alias("node"), "label", "unit", F.col("unit").cast("array<float>").alias("vector")), "vectors", 2)
    members = written(usable.join(nodes.select("label", "unit", "node"), ["label", "unit"]).select("vec_id", "node").distinct(), "members", 2)
    sizes = nodes.groupBy("label").agg(F.count("*").alias("size"))
    if nodes.isEmpty():
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    lists = None
    for attempt in range(TRIES):
        before, lists = lists, merged(lists, by_cells(nodes, sizes, 11 + attempt), 1, threshold)
        for round_ in range(ROUNDS):
            now = merged(lists, by_neighbours(lists, nodes, round_), round_ + 2, threshold)
            new, size = now.agg(F.count_if(F.col("was") == 0), F.count("*")).first()
            release(spark, lists)
            lists = now
            if new <= QUIET * size:
                break
        found = components(link_edges(lists, nodes, threshold)).drop("g")
        recall = audited(nodes, found, threshold)
        if log is not None:
            log.append(recall)
        if recall >= RECALL:
            break
    else:
        found = components(exact_edges(nodes, threshold)).drop("g")
    several = members.groupBy("vec_id").agg(F.count("*").alias("vectors")).where("vectors > 1").select("vec_id", F.lit(True).alias("several"))
    members = members.join(several, "vec_id", "left").select("vec_id", "node", F.coalesce("several", F.lit(False)).alias("several"))
    of_node = members.groupBy("node").agg(F.count("*").alias("n"), F.max("several").alias("marked"))
    nodes = nodes.select("node", "unit").join(of_node, "node")
    n_links = linked_ids(members, nodes.drop("unit"), counted(nodes, found, threshold))
    placed = members.join(found.withColumnRenamed("id", "node"), "node", "left").select("vec_id", F.coalesce("component", "node").alias("component"))
    return rows.select("vec_id").join(n_links, "vec_id", "left").join(smallest(placed), "vec_id", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(True)).alias("kept"),
    )


def smallest(placed: DataFrame) -> DataFrame:
    """vec_id, component_id (its smallest vec_id) from rows (vec_id, component); components that share an id are one."""
    ends = placed.groupBy("vec_id").agg(F.min("component").alias("component"), F.max("component").alias("most"))
    several = ends.where("component < most").select("vec_id", F.col("component").alias("least"))
    if not several.isEmpty():
        moved = components(placed.join(several, "vec_id").where("component <> least").select(F.col("component").alias("a"), F.col("least").alias("b")))
        moved = moved.select(F.col("id").alias("component"), F.col("component").alias("to"))
        ends = ends.join(moved, "component", "left").select("vec_id", F.coalesce("to", "component").alias("component"))
    ids = ends.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    return ends.join(ids, "component").select("vec_id", "component_id")
