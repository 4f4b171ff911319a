import os

from lodestream import storage
from lodestream.storage import BATCH_BYTES, READ_ROWS, bound_batches, materialize, release, shared_dir


def test_a_materialized_table_is_read_back_and_released(spark):
    df = spark.range(10).selectExpr("id", "id % 3 AS k")
    back = materialize(df, "t")
    assert back.dtypes == df.dtypes and sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    assert materialize(df.limit(0), "t").collect() == []
    where, ours = shared_dir(spark).removeprefix("file:"), [p.rsplit("/", 1)[1] for p in storage._written[spark.sparkContext.applicationId]]
    assert ours and set(ours) <= set(os.listdir(where))
    release(spark)
    assert not set(ours) & set(os.listdir(where))


def test_rows_held_at_a_time_are_bounded_and_a_lower_bound_stays(spark):
    names = ("spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
    before = [spark.conf.get(n) for n in names]
    try:
        for given, then in (((8 << 20, 4096), (BATCH_BYTES, READ_ROWS)), ((1000, 100), (1000, 100))):
            for n, v in zip(names, given, strict=True):
                spark.conf.set(n, v)
            bound_batches(spark)
            assert tuple(int(spark.conf.get(n).rstrip("bB")) for n in names) == then
    finally:
        for n, v in zip(names, before, strict=True):
            spark.conf.set(n, v)
