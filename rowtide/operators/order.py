"""Row order as a column: dense row numbers without a single-task window, and neighbours by blocks with a halo."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROW = "row_idx"
#: Rows of a block, within which neighbours are found by one task.
BLOCK_ROWS = 1 << 16
_own: list[str] = []


def shared_path(spark: SparkSession) -> str:
    """A new path in the folder of spark.checkpoint.dir. One of our own where it is unset and all run on this machine;
    ValueError where they don't, since each would write to its own disk."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="rowtide-"))
        root = _own[0]
    return f"{root.rstrip('/')}/rows-{uuid.uuid4().hex}"


def with_row_index(df: DataFrame, *keys: str) -> DataFrame:
    """df with row_idx: 0, 1, ... in the order of keys, which should be unique. Rows are dealt out by ranges of the keys
    and numbered within each; the ranges' counts (one for each partition) give where a range begins."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    rows = rows.withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    path = shared_path(spark)
    rows.write.parquet(path)
    rows = spark.read.schema(rows.schema).parquet(path)
    begin, total = {}, 0
    for part, count in sorted(rows.groupBy("__part").count().collect()):
        begin[part] = total
        total += count
    if not begin:
        return rows.withColumn(ROW, F.lit(0).cast("long")).drop("__part", "__at")
    starts = F.create_map(*(F.lit(x) for p, b in begin.items() for x in (p, b)))
    return rows.withColumn(ROW, F.col("__at") + starts[F.col("__part")]).drop("__part", "__at")


def first_rows(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """The first n rows of df in the order of keys, with row_idx. Each task keeps n rows; the table isn't shuffled."""
    return df.orderBy(*keys).limit(n).withColumn(ROW, F.row_number().over(Window.orderBy(*keys)).cast("long") - 1)


def last_rows(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """The last n rows of df in the order of keys, with row_idx; a count and n rows of each task."""
    total = df.count()
    place = F.row_number().over(Window.orderBy(*(F.col(k).desc_nulls_last() for k in keys)))
    return df.orderBy(*(F.col(k).desc_nulls_last() for k in keys)).limit(n).withColumn(ROW, F.lit(total).cast("long") - place)


def with_neighbours(df: DataFrame, cells: dict[str, tuple[str, int]], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """df (with row_idx) and, for each name in cells, the value of a column some rows away (null beyond the ends).

    Each block of rows is one window partition; rows near its ends are copied to the neighbours that need them.
    """
    back = max([0, *(-k for _, k in cells.values())])
    ahead = max([0, *(k for _, k in cells.values())])
    if not back and not ahead:
        return df.withColumns({name: F.col(f"`{c}`") for name, (c, _) in cells.items()})
    size = max(block_rows, back + ahead + 1)
    block = F.floor(F.col(ROW) / size).cast("long")
    place = F.col(ROW) % size
    copies = F.array_compact(F.array(F.struct(block.alias("b"), F.lit(False).alias("halo")), *([F.when(place >= size - back, F.struct((block + 1).alias("b"), F.lit(True).alias("halo")))] * bool(back)), *([F.when(place < ahead, F.struct((block - 1).alias("b"), F.lit(True).alias("halo")))] * bool(ahead))))
    rows = df.withColumn("__copy", F.explode(copies)).withColumns({"__block": F.col("__copy.b"), "__halo": F.col("__copy.halo")}).drop("__copy")
    order = Window.partitionBy("__block").orderBy(ROW)
    near: dict[str, Column] = {n: (F.lag(f"`{c}`", -k) if k < 0 else F.lead(f"`{c}`", k)).over(order) if k else F.col(f"`{c}`") for n, (c, k) in cells.items()}
    return rows.withColumns(near).where(~F.col("__halo")).drop("__block", "__halo")
