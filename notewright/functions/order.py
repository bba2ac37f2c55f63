"""Global order without a single task: running totals over range partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Bytes of an Arrow batch that goes to a Python worker, and the session's name for that bound.
BATCH_BYTES = 4 << 20
BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
UNBOUNDED = str(2**31 - 2)
#: Rows that a task takes where rows are dealt by a key that later steps stay within.
DEALT = 200_000


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where none is named, as in tests, it
    is a folder in the warehouse, which the driver and all executors share too."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir", None)
        context.setCheckpointDir(named or f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints")
    return context.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the checkpoint folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def tasks_for(df: DataFrame, times: int = 1) -> int:
    """How many tasks the rows (and so many made from each) are dealt to: their memory stays the same
    however many rows there are, which a fixed number of shuffle partitions doesn't do. Small tables take
    fewer than those. Meant for tables as they are read, which Parquet counts by its footers."""
    rows = df.count() * times
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, -(-rows // DEALT), min(usual, rows * 10 // DEALT))


def by_bytes(df: DataFrame) -> DataFrame:
    """The rows, for a function over Arrow batches: where the session sets no bound of its own, a batch
    holds BATCH_BYTES at most (or a single longer row), so long texts don't add up in a worker."""
    conf = df.sparkSession.conf
    if conf.get(BATCH_CONF, UNBOUNDED) == UNBOUNDED:
        conf.set(BATCH_CONF, str(BATCH_BYTES))
    return df


def running_total(df: DataFrame, order: list[Column | str], value: Column, name: str) -> DataFrame:
    """Adds name: the total of value over all rows that come before in the order, which must be
    total. Rows are dealt by ranges of the order; the ranges' totals, one row a partition, are summed
    up and shift what each range counts by itself. The dealt rows are settled first, so that both
    uses see the same ranges even if an executor is lost."""
    dealt = settled(df.repartitionByRange(*order).withColumns({"range": F.spark_partition_id(), "amount": value.cast("long")}))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("range").agg(F.sum("amount").alias("total"))
    shifts = totals.select(F.col("range").alias("of"), F.coalesce(F.sum("total").over(before(Window.orderBy("range"))), F.lit(0)).alias("shift"))
    own = F.coalesce(F.sum("amount").over(before(Window.partitionBy("range").orderBy(*order))), F.lit(0))
    joined = dealt.withColumn(name, own).join(F.broadcast(shifts), F.col("range") == F.col("of"))  # one row a partition
    return joined.withColumn(name, F.col(name) + F.col("shift")).drop("range", "amount", "of", "shift")


def global_index(df: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """Adds name: the row's position from 0 in the order, which must be total."""
    return running_total(df, order, F.lit(1), name)


def prior_value(value: Column | str, keys: list[str], order: list[str]) -> Column:
    """The last value that is not null at the row or before it, in the order within keys."""
    upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return F.last(value, ignorenulls=True).over(upto)


def next_value(value: Column | str, keys: list[str], order: list[str]) -> Column:
    """The first value that is not null at the row or after it, in the order within keys. The order is
    gone through backwards, so a row adds to what is known; a frame that starts at the row would be
    gone through anew for each. Equal rows of the order must be interchangeable."""
    down = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    return F.last(value, ignorenulls=True).over(down)
