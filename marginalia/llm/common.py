"""What the operators share: the shared folder, written tables, components."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.session import ship_package
from ..sources.tables import shared_dir
from . import caches


#: Bytes of the rows that a Python worker gets at once; Spark's own bound is far above what a small executor can hold of several.
ARROW_BYTES = 4 << 20


def prepared(spark: SparkSession) -> None:
    """Workers get the package, and rows in batches of bounded bytes; the driver keeps short descriptions of plans, which adaptive execution writes anew after every stage."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    spark.conf.set("spark.sql.ui.explainMode", "simple")
    spark.conf.set("spark.sql.maxPlanStringLength", 20_000)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepared(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text, of their types, and the columns named more; whatever else docs has goes."""
    prepared(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def fresh(docs: DataFrame, name: str) -> str:
    """name, lengthened until docs has no such column."""
    have = {c.lower() for c in docs.columns}
    while name.lower() in have:
        name += "_"
    return name


#: Input splits that one task reads, one after another, where few() knows their number.
SPLITS = 4


def few(df: DataFrame, waves: int = 16, splits: int = 0) -> DataFrame:
    """df in so many partitions for each core at most, by running several in one task, one after another.

    Files then number a few for each core, whatever the number of partitions before. Memory is that
    of one partition at a time. splits: those of the input of a df without shuffles; a task then
    has SPLITS of them at most once there are many, so its bytes stay bounded at any size.
    """
    return df.coalesce(max(1, waves * df.sparkSession.sparkContext.defaultParallelism, -(-splits // SPLITS)))


def written(df: DataFrame, name: str, waves: int = 8) -> DataFrame:
    """df as a table written to the shared folder and read again: lineage ends here, so a lost executor costs a re-read. waves: files for each core at most; 0: a file for each of df's tasks."""
    spark = df.sparkSession
    prepared(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    (few(df, waves) if waves else df).write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    trim_driver(spark)
    return out


def trim_driver(spark: SparkSession) -> None:
    """Gives free native pages of the driver's JVM back to the system, in milliseconds.

    Measured after two runs of the pipeline: 1256 MB resident, 112 MB of heap in use, and 209 MB
    returned by one trim. That the C library keeps these for the many threads (548 after
    near-duplicates, of which 200 of the block manager and some 150 of exchanges and query stages)
    is likely, but was not measured apart. JVMs without the command
    (before 17.0.9, or without its bean) keep them.
    """
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    of = jvm.java.lang.Class.forName
    names = ["javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;"]
    types, args = gateway.new_array(jvm.java.lang.Class, len(names)), gateway.new_array(jvm.java.lang.Object, len(names))
    try:
        for i, name in enumerate(names):
            types[i] = of(name)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        of("javax.management.MBeanServer").getMethod("invoke", types).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JJavaError:
        pass


def release(spark: SparkSession, *frames: DataFrame) -> None:
    """Frees shuffle files of finished stages, and the tables behind frames that nothing reads any more."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for df in frames:
        path = hadoop.Path(df.written_to)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    caches.trim()
    spark.sparkContext._jvm.System.gc()
    trim_driver(spark)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def _settled(edges: DataFrame) -> bool:
    """Whether edges (g, u, v) are stars: each u once, and no v is a u."""
    ends = edges.select("g", F.col("u").alias("id"), F.lit(1).alias("leaf"), F.lit(0).alias("centre"))
    ends = ends.union(edges.select("g", F.col("v").alias("id"), F.lit(0).alias("leaf"), F.lit(1).alias("centre")))
    return ends.groupBy("g", "id").agg(F.sum("leaf").alias("leaf"), F.max("centre").alias("centre")).where("leaf + centre > 1").isEmpty()


def components(edges: DataFrame, a: str = "a", b: str = "b", graph: str | None = None) -> DataFrame:
    """Connected components of undirected edges: rows (g, id, component), component the smallest id reachable; ids without edges are absent.

    graph names a column that tells several graphs apart, g in the result (0 without one).

    Large-star / small-star rounds over DataFrames until only stars are left: each round is two
    aggregations with map-side combine, and its edges are written to the shared folder. A hub's
    neighbours are never gathered in one task: only the minimum of a node's neighbours is
    aggregated and joined back. The joins stay sort-merge, lest every round leave broadcasts in the
    driver's memory.
    """
    spark = edges.sparkSession
    g = F.col(graph) if graph else F.lit(0)
    now = written(edges.select(g.cast("int").alias("g"), F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct(), "edges", 1)
    while not _settled(now):
        # large star: every larger neighbour of u goes to the least of u and its neighbours
        both = now.union(now.select("g", "v", "u"))
        least = both.groupBy("g", "u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least.hint("merge"), ["g", "u"]).where("v > u").select("g", F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        # small star: u and its smaller neighbours go to the least of them
        least = large.groupBy("g", "u").agg(F.min("v").alias("m"))
        small = large.join(least.hint("merge"), ["g", "u"]).select("g", F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        after = written(small.union(least.select("g", "u", "m")).distinct(), "edges", 1)
        release(spark, now)
        now = after
    return now.select("g", F.col("u").alias("id"), F.col("v").alias("component")).union(
        now.select("g", F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )
