"""Look-ups in a clustered table read the row groups that match."""

import hashlib

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from mailweave.operators import browse as B
from mailweave.sources.tables import write_clustered

ROWS = 60_000


def rows_read(frame):
    """Rows that leave the file scan, and the result."""
    result = frame.collect()
    plan = frame._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size())), result


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("clustered") / "mails")
    rows = spark.range(ROWS).select(
        F.sha2(F.col("id").cast("string"), 256).alias("id"), F.concat(F.lit("m"), F.xxhash64("id"), F.lit("@x.org")).alias("message_id"),
        F.when(F.col("id") % 23 > 0, F.timestamp_seconds(F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(10_000_000)))).alias("sent_at"),
        F.repeat(F.sha2(F.col("id").cast("string"), 512), 4).alias("body_text"))
    write_clustered(rows, path, row_group_bytes=256 * 1024)
    return spark.read.parquet(path)


def test_look_up_by_id(spark, table):
    wanted = hashlib.sha256(b"4711").hexdigest()
    read, found = rows_read(B.by_id(table, wanted))
    assert [r.id for r in found] == [wanted] and 0 < read < ROWS / 10
    read, found = rows_read(B.by_id(table, "no such id"))
    assert not found and read < ROWS / 10


def test_look_up_by_message_id(spark, table):
    wanted = table.filter("message_id like 'm-%'").orderBy("id").first().message_id
    read, found = rows_read(table.filter(F.col("message_id") == wanted))
    assert len(found) == 1 and 0 < read < ROWS / 10


def test_date_range(spark, table):
    inside = B.in_date_range("1970-02-01 00:00:00", "1970-02-03 00:00:00")
    read, found = rows_read(table.filter(inside).select("id", "sent_at"))
    want = table.select("sent_at").toPandas().sent_at.between("1970-02-01", "1970-02-03").sum()
    assert len(found) == want > 0 and read < ROWS / 5


def test_rows_are_worked_out_once_and_lie_in_ranges(spark, tmp_path):
    worked_out = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def text(n):
        worked_out.add(1)
        return f"text {n}"

    # A seventh of the rows has no time, a third one and the same.
    at = F.when(F.col("id") % 7 > 0, F.when(F.col("id") % 3 > 0, F.timestamp_seconds(F.pmod(F.xxhash64("id"), F.lit(10**7)))).otherwise(F.timestamp_seconds(F.lit(5))))
    rows = spark.range(0, ROWS, 1, 4).select("id", at.alias("sent_at"), text("id").alias("body_text"))
    write_clustered(rows, str(tmp_path / "once"), looked_up=("id",))
    assert worked_out.value == ROWS
    stored = spark.read.parquet(str(tmp_path / "once"))
    assert stored.select("id", "body_text").distinct().count() == ROWS
    order = F.struct("sent_at", "id")
    files = stored.groupBy(F.input_file_name().alias("f")).agg(F.min(order).alias("low"), F.max(order).alias("high"), F.count("*").alias("n"))
    found = files.orderBy("low").select("n", (F.lead("low").over(Window.orderBy("low")) > F.col("high")).alias("apart")).collect()
    assert len(found) > 4 and all(r.apart for r in found[:-1]) and max(r.n for r in found) < ROWS / 3


@pytest.mark.parametrize("n", [0, 1])
def test_few_rows(spark, tmp_path, n):
    write_clustered(spark.range(n).select("id", F.lit(None).cast("timestamp").alias("sent_at")), str(tmp_path / "few"), looked_up=("id",))
    assert spark.read.parquet(str(tmp_path / "few")).count() == n
