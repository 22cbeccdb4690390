"""What stays on disk: shuffles go with their action, passing stages with their block."""

import os
import time

import pytest

from pyspark.ml.linalg import Vectors

from tenderlens.operators import flatten, training
from tenderlens.session import configure
from tenderlens.sources.staging import discard, passing, stage, stage_all


def shuffle_files(spark):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {f for folder in manager.localDirs() for _, _, files in os.walk(folder.getPath())
            for f in files if f.startswith("shuffle_")}


def test_shuffle_files_go_with_the_action_that_wrote_them(spark, tmp_path):
    configure(spark)
    before = shuffle_files(spark)
    grouped = spark.range(100_000).groupBy("id").count()
    grouped.write.parquet(str(tmp_path / "out"))
    for _ in range(50):
        if not shuffle_files(spark) - before:
            break
        time.sleep(0.2)
    assert not shuffle_files(spark) - before
    assert grouped.count() == grouped.count() == 100_000


def folder_of(df):
    return df.inputFiles()[0].removeprefix("file:").rsplit("/", 1)[0]


def test_passing_stages_go_with_their_block(spark):
    df = spark.range(10)
    with passing(spark):
        gone = [stage(df), *stage_all({"a": df, "b": df}).values()]
        with passing(spark):
            inner = folder_of(stage(df))
        assert not os.path.exists(inner)
        kept = stage(df, lasting=True)
        folders = [folder_of(x) for x in gone]
        assert all(map(os.path.exists, folders))
    assert not any(map(os.path.exists, folders)) and kept.count() == 10
    outside = stage(df)
    folder = folder_of(outside)
    discard(outside)
    assert not os.path.exists(folder)


@pytest.mark.parametrize("most", [500_000, 0], ids=["looked up", "shuffled"])
def test_rolled_up_rows_are_the_same_looked_up_and_shuffled(spark, most):
    rows = spark.createDataFrame(
        [(1, 1, 7, 9, 1, "10.11", 10, 6, 2), (2, 1, 7, 9, 2, "10.12", 20, None, 3),
         (3, 2, 8, 9, 1, "10.11", 10, 6, None), (4, 2, None, 9, 3, "20.11", 5, 5, 1),
         (5, 3, 8, 9, 4, None, 8, 0, 2), (6, 3, 8, 9, 3, "20.11", 5, 5, 4),
         (6, 3, 8, 9, 3, "20.11", 5, 5, 4)],
        "valID long, cntrID long, supID long, orgID long, okpdID int, okpd string, "
        "okpd_cntr_num long, okpd_good_cntr_num long, sup_okpd_cntr_num long")
    got = flatten.roll_up_codes(rows, most_suppliers=most).select(
        "valID", "okpd2", "okpd_cntr_num", "sup_okpd_cntr_num").orderBy("valID").collect()
    assert [tuple(r) for r in got] == [
        (1, "10", 30, 5), (2, "10", 30, 5), (3, "10", 30, 0), (6, "20", 5, 4), (6, "20", 5, 4)]


@pytest.mark.parametrize("most, wanted", [(200_000, 8), (5, 20)])
def test_a_forest_has_as_many_partitions_as_cores_or_as_its_rows_need(
        spark, monkeypatch, most, wanted):
    """Histograms of all open nodes are shuffled by every partition."""
    seen = []
    monkeypatch.setattr(training, "FOREST_ROWS", most)
    monkeypatch.setattr(training, "fitted_model",
                        lambda clf, data, rows, n: seen.append((data.rdd.getNumPartitions(), rows)))
    data = spark.createDataFrame([(i, i % 2, Vectors.dense([i])) for i in range(100)],
                                 ["cntrID", "cntr_result", "features"]).repartition(50)
    training.fit_encoded(training.Classifier("RandForest", "x"), data, {}, ["a"])
    assert spark.sparkContext.defaultParallelism == 8 and seen == [(wanted, 100)]
