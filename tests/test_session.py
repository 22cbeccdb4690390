"""Sizes of partitions under the package's session settings."""

import pytest

from tenderlens.session import INITIAL, LEAST_PARTITIONS, configure


@pytest.fixture
def partitions(spark):
    """Sets the number of shuffle partitions of a caller, and that from which AQE coalesces."""
    before = spark.conf.get("spark.sql.shuffle.partitions")

    def put(number, initial=None):
        spark.conf.set("spark.sql.shuffle.partitions", number)
        spark.conf.unset(INITIAL)
        if initial:
            spark.conf.set(INITIAL, initial)
        return configure(spark)

    yield put
    put(before)


def test_shuffled_partitions_have_a_bounded_size(partitions):
    """50 MB that do not compress go to tasks of some 8 MB, however few partitions are set."""
    spark = partitions("2")
    rows = spark.range(2_000_000).selectExpr("xxhash64(id) AS a", "xxhash64(id, 1) AS b",
                                             "xxhash64(id, 2) AS c")
    assert rows.groupBy("a", "b", "c").count().rdd.getNumPartitions() >= 6


@pytest.mark.parametrize("number, initial, wanted", [
    ("4", None, LEAST_PARTITIONS), ("3000", None, 3000), ("4", "5000", 5000)])
def test_more_partitions_of_a_caller_stay(partitions, number, initial, wanted):
    spark = partitions(number, initial)
    assert int(spark.conf.get(INITIAL)) == wanted
    assert spark.conf.get("spark.sql.shuffle.partitions") == number
