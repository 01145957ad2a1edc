"""Tables between steps: kept as long as they are needed, in a folder that all can reach."""

import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from seqharvest import storage


def test_tables_of_steps_are_deleted(spark):
    with storage.steps(spark):
        with storage.steps(spark):
            gone = storage.written(spark.range(3), "gone").inputFiles()
            kept = storage.written(spark.range(5), "kept", outlives=True)
            assert all(os.path.exists(f.removeprefix("file://")) for f in gone)
        assert not any(os.path.exists(f.removeprefix("file://")) for f in gone) and kept.count() == 5
        inside = kept.inputFiles()
    assert not any(os.path.exists(f.removeprefix("file://")) for f in inside)
    assert storage.written(spark.range(2), "free").count() == 2


def test_no_private_folder_on_a_cluster(spark):
    class Context:
        master, applicationId = "spark://host:7077", "app"

    class Session:
        sparkContext, conf = Context, {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        storage.shared_dir(Session)
    Context.master = "local-cluster[3,2,3000]"
    with pytest.raises(RuntimeError):
        storage.shared_dir(Session)
    Context.master = "local[4]"
    assert storage.shared_dir(Session).startswith("file://")


def test_a_cut_table_is_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    held = storage.cut(spark.range(100).mapInArrow(run, "id long"))
    assert held.count() == 100 and seen.value == 100


def test_threads_keep_their_own_tables(spark):
    first, second, errors = threading.Event(), threading.Event(), []

    def work(mine, other):
        try:
            with storage.steps(spark):
                held = storage.written(spark.range(7), "held")
                mine.set()
                assert other.wait(60)
                if mine is second:
                    time.sleep(1)  # the other one has left its block
                assert held.count() == 7
        except BaseException as e:
            errors.append(e)

    threads = [threading.Thread(target=work, args=x) for x in ((first, second), (second, first))]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors


def test_a_bucketed_table_is_joined_without_a_shuffle(spark):
    df = spark.range(1000).withColumn("a", F.col("id") % 10).repartition(4, "a")
    held = storage.cut(df, "a")
    plan = held.groupBy("a").count()._jdf.queryExecution().executedPlan().toString()
    assert held.count() == 1000 and "Exchange" not in plan
