"""Tables at rest in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where it is unset on one machine, as in tests.  A cluster without one is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = held.get() if held.isDefined() else None
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="cladeframe-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows read from a table in the shared folder: lineage ends there, and lost executors take nothing with them."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder by Spark's own file system, wherever it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(df: DataFrame) -> None:
    """Removes a written table that nothing will read again."""
    remove(df.sparkSession, df.written_to)


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows of the driver as a table.  By Arrow the JVM reads them itself; from a list of tuples executors would start Python
    workers of another kind for them, which stay."""
    fields = StructType.fromDDL(schema)
    columns = list(zip(*rows)) or [()] * len(fields)
    return spark.createDataFrame(pa.table({f.name: pa.array(c) for f, c in zip(fields, columns)}), fields)


def bounded(df: DataFrame, most: int, what: str) -> DataFrame:
    """df, which is to be collected or broadcast, if it has at most so many rows; an error beyond."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} {what}")
    return df


def numbered(rows: DataFrame, *order: str, without: tuple[str, ...] = ()) -> DataFrame:
    """rows with row_number from 0 in the given order.  A range shuffle orders them; only a count for each partition comes to the driver.
    Columns that only the order needs (without) are not written."""
    spark = rows.sparkSession
    placed = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).drop(*without).withColumn("_place", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("_place", 33)
    counts = sorted((r.part, r.n) for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    starts, at = [], 0
    for k, n in counts:
        starts.append((k, at))
        at += n
    table = small_table(spark, starts, "_part long, _start long")  # a row for each partition
    number = F.col("_start") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("_part", part).join(F.broadcast(table), "_part").withColumn("row_number", number).drop("_part", "_start", "_place")


def sums_before(rows: DataFrame, keys: list[str], order: list[str], *columns: str) -> DataFrame:
    """rows with before_<column>: the sums of the columns (doubles) over the rows of the same keys that come earlier in the order, which
    tells all rows of a key apart.

    A range shuffle by keys and order places the rows; each partition adds up its own, and what a key has in earlier partitions comes
    from a row for each partition on the driver: its last key, and that key's sums.  So no task holds more than a partition of any key."""
    spark = rows.sparkSession
    placed = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_place"))
    placed = written(placed, "placed")
    key = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
    edge = placed.groupBy("_part").agg(F.min_by(key, "_place").alias("first"), F.max_by(key, "_place").alias("last"))
    tails = placed.join(F.broadcast(edge), "_part").where(key == F.col("last")).groupBy("_part", "first", "last").agg(*(F.sum(c).alias(c) for c in columns))  # a row for each partition
    found, carried, at, offsets = sorted(tails.collect(), key=lambda r: r["_part"]), [0.0] * len(columns), None, []
    for r in found:
        before = carried if r.first == at else [0.0] * len(columns)
        offsets.append((r["_part"], r.first, *map(float, before)))
        own = [float(r[c]) for c in columns]
        carried = [a + b for a, b in zip(before, own)] if r.first == r.last else own
        at = r.last
    table = small_table(spark, offsets, "_part int, _first string, " + ", ".join(f"_more_{c} double" for c in columns))
    earlier = Window.partitionBy("_part", *keys).orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    own = placed.withColumns({f"before_{c}": F.coalesce(F.sum(c).over(earlier), F.lit(0.0)) for c in columns}).join(F.broadcast(table), "_part")
    more = {f"before_{c}": F.col(f"before_{c}") + F.when(key == F.col("_first"), F.col(f"_more_{c}")).otherwise(0.0) for c in columns}
    return own.withColumns(more).drop("_part", "_place", "_first", *(f"_more_{c}" for c in columns))


def last_before(rows: DataFrame, number: str, block: int = 100_000, **values: Column) -> DataFrame:
    """rows with, for each name, the last value that is not null among the rows of smaller numbers (row numbers without gaps).

    Rows go to tasks by blocks of numbers, whatever their keys; what earlier blocks leave is a table with a row for each block."""
    at = F.floor(F.col(number) / block)
    rows = rows.withColumns({"_block": at, **{f"_own_{c}": v for c, v in values.items()}})
    ends = rows.groupBy("_block").agg(*(F.max_by(f"_own_{c}", F.when(F.col(f"_own_{c}").isNotNull(), F.col(number))).alias(f"_end_{c}") for c in values))
    earlier = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    ends = ends.select("_block", *(F.last(f"_end_{c}", ignorenulls=True).over(earlier).alias(f"_more_{c}") for c in values))
    own = Window.partitionBy("_block").orderBy(number).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumns({f"_last_{c}": F.last(f"_own_{c}", ignorenulls=True).over(own) for c in values}).join(F.broadcast(ends), "_block")
    return out.withColumns({c: F.coalesce(f"_last_{c}", f"_more_{c}") for c in values}).drop("_block", *(f"_{k}_{c}" for k in ("own", "more", "last") for c in values))
