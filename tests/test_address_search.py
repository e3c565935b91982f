"""Parts of addresses through trigrams against testing every address."""

import re

import pytest
from pyspark.sql import functions as F

from mailweave.operators import address_search as A
from mailweave.operators import keyword as K
from mailweave.session import scratch_path

ADDRESSES = ["ann@example.com", "bob@example.org", "Carol.O'Neil@sub.example.com", "a_b@x", "aXb@x", "50%@x.net", "xy", "zoë@exämple.de", "user1@example.com",
             "user12@example.com", "aaaa@aaaa"]


@pytest.mark.parametrize("part", ["example", "EXAMPLE.com", "b@", "*", "a*b", "us?r1", "user12", "_b@", "%", "zoë@ex", "nobody", "aaa", "exa*com", "x?mple", "\\", "o'n"])
def test_matches_are_those_of_the_pattern(spark, part):
    rows = spark.createDataFrame([(a,) for a in ADDRESSES], "term string")
    pattern = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in part.lower())
    got = {r.term for r in A.matching(part, rows, A.grams_of(rows)).collect()}
    assert got == {a for a in ADDRESSES if re.search(pattern, a)}


def test_the_filter_reads_no_texts_and_no_other_folders(spark):
    mails = spark.range(400).select("id", F.lit("subject").alias("subject"), F.concat(F.lit("text of "), F.col("id")).alias("body_text"), F.lit("").alias("summary"),
                                    F.concat(F.lit("user"), F.col("id") % 90, F.lit("@example.com")).alias("sender"))
    folder = scratch_path(spark, "index-test")
    K.write_index(mails, folder)
    found = K.sender_filter(K.Index.read(spark, folder), "user12")
    assert {r.id for r in found.collect()} == {i for i in range(400) if i % 90 == 12}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "body_text" not in plan and "summary" not in plan
    read = re.findall(r"PartitionFilters: \[([^\n]*?)\], PushedFilters", plan)
    assert read and any("term_bucket" in r for r in read)
