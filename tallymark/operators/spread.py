"""Keep costly steps parallel, computed once and in place."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir


def spread(rows: DataFrame, *columns: str) -> DataFrame:
    """Hash rows over the session's shuffle partitions.

    Adaptive execution merges partitions by bytes; a few megabytes of short texts would
    then be matched by one task. An explicit partition number is left as it is.
    """
    count = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(count, *columns)


def fence(rows: DataFrame, name: str) -> DataFrame:
    """Count the rows that pass, and keep later filters above this point.

    A filter on a costly column would otherwise be pushed below the column's own
    projection, copied with all it is made of, and run on rows not yet made distinct.
    """
    return rows.observe(name, F.count(F.lit(1)).alias("rows"))


def settle(rows: DataFrame) -> DataFrame:
    """Write rows that several branches read to the shared checkpoint folder, once."""
    folder = checkpoint_dir(rows.sparkSession)
    context = rows.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(folder)
    return rows.checkpoint()


def kept(rows: DataFrame, name: str) -> DataFrame:
    """Write rows to the shared folder once and read them from there, so that their size is known when joins are chosen."""
    spark = rows.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


#: Parts a slot that rows are dealt to where a scan does not fill the slots.
WAVES = 3


def fill_slots(rows: DataFrame) -> DataFrame:
    """Spread a scan whose rows lie in fewer splits than there are task slots, or mostly in a few of them.

    Long texts are CPU-bound, and a row group is read by the one split that holds its middle, however many splits its file
    has: a table of one row group is one task. The rows of each split are counted first, which reads no column, and a scan
    whose largest split has more than a slot's share is dealt out by hash. Other scans are left alone.
    """
    slots = rows.sparkSession.sparkContext.defaultParallelism
    splits = rows.rdd.getNumPartitions()
    held = rows.groupBy("_metadata.file_path", "_metadata.file_block_start").agg(F.count(F.lit(1)).alias("n"))
    total, most = held.agg(F.sum("n"), F.max("n")).first()  # two numbers
    if not total or most * slots <= total * 1.5:
        return rows
    return rows.repartition(max(splits, WAVES * slots), F.xxhash64(*rows.columns))
