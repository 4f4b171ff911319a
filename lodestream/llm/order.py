"""Sorted runs of a table and the place of each row in them, without a window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestream.storage import materialize

_ROW_BITS = 33


def sorted_runs(df: DataFrame, *keys: str | Column, label: str) -> DataFrame:
    """``df`` (cheap to read twice) written in the order of ``keys``, with ``at``, a long that ascends with it.

    Rows are dealt by ranges of the keys and sorted there; one key with many rows is split only if a further
    key tells its rows apart.
    """
    runs = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return materialize(runs.withColumn("at", F.monotonically_increasing_id()), label)


def numbered(runs: DataFrame, group: str) -> DataFrame:
    """Adds ``pos``, from 0 in each group, and ``size``, the group's rows, to written runs whose first key is ``group``.

    Rows meet their run's start by (run, group), so a group of any size is dealt as evenly as the runs are;
    the window is over one row a run and group.
    """
    run = F.shiftrightunsigned("at", _ROW_BITS)
    spans = runs.groupBy(group, run.alias("run")).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    w = Window.partitionBy(group)
    before = F.sum("n").over(w.orderBy("run").rowsBetween(Window.unboundedPreceding, -1))
    starts = spans.select(group, "run", "first", F.coalesce(before, F.lit(0)).alias("start"), F.sum("n").over(w).alias("size"))
    rows = runs.withColumn("run", run).join(starts, [group, "run"])
    return rows.withColumn("pos", F.col("start") + F.col("at") - F.col("first")).drop("run", "first", "start", "at")
