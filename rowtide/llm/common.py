"""What the operators share: tables, the shared working folder, intermediate tables and components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rules: space and the characters 9 to 13.
BLANKS = " \t\n\x0b\x0c\r"
#: The same as the inside of a Java regular expression's class.
BLANK_CLASS = r" \t\n\x0B\f\r"

_own_folder: list[str] = []
#: Paths of the tables stashed inside each `alone` that runs.
_scopes: list[list[str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share. One of our own where it is unset and all run on
    this machine; ValueError where they don't, since each would write to its own disk."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        path = spark._jvm.org.apache.hadoop.fs.Path(named)
        full = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
        return full.replace("file:/", "file:///", 1) if full.startswith("file:/") and not full.startswith("file://") else full
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _own_folder:
        _own_folder.append("file://" + tempfile.mkdtemp(prefix="rowtide-"))
    return _own_folder[0]


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"


#: Spark's setting that drops a query's shuffle files when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stash(df: DataFrame, tag: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: lineage ends here and outlives lost executors. The
    query's shuffle files go when it is written, since nothing reads them again."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    for paths in _scopes[-1:]:
        paths.append(path)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def alone(make: Callable[[], DataFrame], tag: str) -> DataFrame:
    """What make gives, stashed; the tables that are stashed until then are deleted then, so that none of them
    waits on disk for the pipeline's end."""
    own: list[str] = []
    _scopes.append(own)
    try:
        df = make()
    finally:
        _scopes.pop()
    out = stash(df, tag)
    _delete(df.sparkSession, own)
    return out


def fresh(pairs: DataFrame, done: DataFrame) -> DataFrame:
    """The pairs (a, b) that are not among those done."""
    return pairs.join(done.select("a", "b"), ["a", "b"], "left_anti")


def discard(*frames: DataFrame) -> None:
    """Deletes stashed tables that no later plan reads."""
    for df in frames:
        _delete(df.sparkSession, {f.rsplit("/", 1)[0] for f in df.inputFiles()})


def _delete(spark: SparkSession, paths: Iterable[str]) -> None:
    for top in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(top)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def renamed(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """docs with columns c0, c1, ... and, beside them, doc_id and text, so that no name that docs has can clash; and the
    former's names in order."""
    own = [f"c{k}" for k in range(len(docs.columns))]
    of = {name: F.col(c).alias(name) for name, c in zip(docs.columns, own) if name in ("doc_id", "text")}
    return docs.toDF(*own).select("*", of["doc_id"], of["text"]), own


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Bounds what an Arrow batch holds, since one text may have megabytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def clean_texts(column):
    """The texts of an Arrow column as a list of str; null is the empty text."""
    return [t or "" for t in column.to_pylist()]


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """The connected components of links (a, b: long, no nulls): rows (id, component), component the smallest id
    that can be reached. Ids without links are not in the result; an empty table of links gives an empty result.

    Alternating large-star and small-star steps (Kiveris et al., 2014): each node's neighbours are pointed at its
    smallest neighbour, so that a star of any size takes a logarithmic number of passes and no node gathers its
    group. Every pass is written to the shared folder.
    """
    edges = stash(links.select("a", "b").where("a <> b").distinct(), "links")
    for _ in range(rounds):
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: each node and its smaller neighbours go to the smallest of them
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        floor = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(floor, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(floor.select("a", F.col("m").alias("b"))).distinct()
        now = stash(small, "links")
        discard(edges)
        edges = now
        # done if each node has one parent, which has none
        seen = edges.select(F.col("a").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select(F.col("b").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if seen.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1").isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} passes")
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots)
