"""Records of one file stay spread over tasks, and what is made of them."""

import pytest
from pyspark.sql import functions as F

from attestra.functions import clean
from attestra.schema import attempt_ref
from attestra.sources import readers


@pytest.fixture
def small_splits(spark):
    conf = {"spark.sql.files.maxPartitionBytes": "2000", "spark.sql.files.openCostInBytes": "0",
            "spark.sql.autoBroadcastJoinThreshold": "-1"}
    was = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in was.items():
        spark.conf.set(k, v)


def test_records_of_one_csv_file_are_parsed_in_several_tasks(small_splits, tmp_path):
    path = tmp_path / "one.csv"
    path.write_text("user_id,address\n" + "".join(f'u{i},"street {i * 7919}\nroom {i * 104729}"\n' for i in range(600)))
    rows = readers.read_attempts_csv(small_splits, str(path)).select(
        "record_id", "user_id", "address", F.spark_partition_id().alias("task")).collect()
    assert sorted((r[0], r[1], r[2]) for r in rows) == [
        (i, f"u{i}", f"street {i * 7919}\nroom {i * 104729}") for i in range(600)]
    assert len({r["task"] for r in rows}) > 1


def test_references_equal_the_pattern(spark):
    ids = [0, 7, 99_999, 999_999, 1_000_000, 2 ** 62, -5, None]
    d = spark.createDataFrame([(i,) for i in ids], "id long")
    for a, b in d.select(attempt_ref(F.col("id")), F.format_string("EVAL-%06d", "id")).collect():
        assert a == b


def test_dates_without_a_clock_keep_their_moment(spark):
    texts = ["2024-03-05", "20240305T00", "2024-W10", "2024-W10-2", "2024-03-05 06", "2024-03-05T06:07", "2024-3-5", "2024-02-30"]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in d.select(F.unix_timestamp(clean.parse_timestamp(F.col("t")))).collect()]
    day = 1709596800
    assert got == [day, day, day - 86400, day, day + 6 * 3600, day + 6 * 3600 + 7 * 60, day, None]
