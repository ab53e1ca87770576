"""Slices of a table are written without a shuffle, unless they are small."""

import tempfile

from lectern.plans.stream_registry import FILES, in_files, in_parts
from pyspark.sql import functions as F


def test_rows_of_many_parts_are_not_shuffled(spark, capsys):
    path = tempfile.mkdtemp() + "/rows"
    rows = spark.range(1000).repartition(3 * FILES)
    rows.write.parquet(path)
    spark.conf.set("spark.sql.files.openCostInBytes", 1 << 26)  # a part of its own for each file
    try:
        many = in_parts(spark.read.parquet(path), FILES)
        many.explain()
        assert "Exchange" not in capsys.readouterr().out
        assert many.rdd.getNumPartitions() == FILES and many.count() == many.distinct().count() == 1000
        few = in_parts(spark.read.parquet(path).where("id < 0").unionByName(spark.range(5)).coalesce(1), FILES)
        assert few.rdd.getNumPartitions() == FILES and few.count() == 5
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_files_of_a_slice_stand_together(spark):
    path = in_files(spark.range(300).withColumn("at", F.col("id")), F.col("at"), "id")
    files = spark.read.parquet(path).select("id", "_metadata.file_path", "_metadata.file_modification_time").collect()
    assert sorted(r[0] for r in files) == list(range(300))
    assert len(spark.read.parquet(path).inputFiles()) == 4 * FILES
