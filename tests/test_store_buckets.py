"""The maintained search's buckets are those of Spark's shuffles by sid."""

import pytest
from pyspark.sql import functions as F

from seqharvest.operators.maintained import Maintained

SCHEMA = "sid long, tid int, item int, util long"


def test_buckets_are_parts_of_a_shuffle_by_sid(spark, tmp_path):
    at, n = f"{tmp_path}/store", int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = [(s, t, i, 3 * s % 7 + 1) for s in range(40) for t in range(2) for i in (1, 2)]
    Maintained(spark, at, 0.05).add(spark.createDataFrame(rows, SCHEMA))
    for kind in ("positions", "sequences", "ends"):
        assert spark.read.parquet(f"{at}/{kind}").where(F.col("bucket") != F.pmod(F.hash("sid"), F.lit(n))).isEmpty()
    dealt = spark.range(40).repartition(n, "id").where(F.spark_partition_id() != F.pmod(F.hash("id"), F.lit(n)))
    assert dealt.isEmpty()
    # a store that was dealt out otherwise is refused, not read wrongly
    spark.read.parquet(f"{at}/manifest").drop("by", "batch").write.mode("overwrite").parquet(f"{tmp_path}/old/manifest/batch=0")
    with pytest.raises(ValueError, match="another hash"):
        Maintained(spark, f"{tmp_path}/old", 0.05)
