import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from siltstone.sources import staging


def _written(path, n):
    rng = np.random.default_rng(0)
    pq.write_table(pa.table({"id": np.arange(n), "x": rng.random(n), "text": [f"t{i}" for i in range(n)]}), path)
    return str(path)


def test_tables_of_one_row_group_use_all_cores(spark, tmp_path, monkeypatch):
    large, small = _written(tmp_path / "large.parquet", 40_000), _written(tmp_path / "small.parquet", 10)
    monkeypatch.setattr(staging, "SPREAD_BYTES", 100_000)
    df = staging.read(spark, large)
    assert df.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and staging.read(spark, small).rdd.getNumPartitions() == 1
    got, want = (x.agg(F.count("*"), F.sum("id"), F.bit_xor(F.xxhash64("id", "x", "text"))).first() for x in (df, spark.read.parquet(large)))
    assert got == want
    plan = df.where("id > 5").select("id")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:bigint>" in plan and "GreaterThan(id,5)" in plan


def test_columns_and_filters_reach_the_scan_of_folders(spark, tmp_path):
    folder = str(tmp_path / "parts")
    spark.range(1000).repartition(6).write.parquet(folder)
    assert staging.read(spark, folder).where("id < 3").count() == 3
