"""Any order of batches gives the header threads of one batch."""

import random

import pytest

from mailweave.operators import threads as T
from mailweave.operators.growing_threads import GrowingThreads

SCHEMA = "id long, message_id string, in_reply_to string, references_header string, subject string"


def corpus(seed, n=60):
    pick = random.Random(seed)
    rows = []
    for i in range(n):
        refs = " ".join(f"<m{pick.randrange(n + 8)}>" for _ in range(pick.choice([0, 0, 1, 2, 4])))
        rows.append((i, pick.choice([f"m{i}", f"m{i}", f"m{pick.randrange(n)}", "", None]), pick.choice([None, "", f"m{pick.randrange(n + 8)}"]), refs or None,
                     pick.choice(["", None, f"Re: s{i % 5}", f"s{i % 5}"])))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_any_order_of_batches(spark, tmp_path, seed):
    rows = corpus(seed)
    want = {r.id: r.thread_key for r in T.global_thread_keys(spark.createDataFrame(rows, SCHEMA)).collect()}
    order = list(rows)
    random.Random(seed + 10).shuffle(order)
    grown, at = GrowingThreads(spark, str(tmp_path / "t"), buckets=4), []
    cuts = [0, 1, 25, 40, 60]
    for batch, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        before = {r.id: r.thread_key for r in grown.keys().collect()} if batch else {}
        mails = spark.createDataFrame(order[a:b], SCHEMA)
        touched = {r.thread_key for r in grown.add(batch, mails).collect()}
        if batch == 2:
            grown.add(batch, mails)  # a repeated batch changes nothing
        at += order[a:b]
        now = {r.id: r.thread_key for r in grown.keys().collect()}
        assert now == {r.id: r.thread_key for r in T.global_thread_keys(spark.createDataFrame(at, SCHEMA)).collect()}
        # Old and new threads of moved mails, and the threads of the batch, are told; no others.
        moved = {k for i in before if before[i] != now[i] for k in (before[i], now[i])}
        assert touched == {k for k in moved | {now[r[0]] for r in order[a:b]} if k is not None}
    assert now == want


def test_a_late_parent_moves_those_that_wait(spark, tmp_path):
    grown = GrowingThreads(spark, str(tmp_path / "t"), buckets=4)
    grown.add(0, spark.createDataFrame([(1, "b", "a", None, "x"), (2, "c", None, "<r> <b>", "y"), (3, "d", None, None, "z")], SCHEMA))
    assert {r.id: r.thread_key for r in grown.keys().collect()} == {1: "msg:b", 2: "msg:b", 3: "msg:d"}
    changes = set(grown.placed.manifest.read()["changes"])
    touched = grown.add(1, spark.createDataFrame([(4, "r", None, None, "late")], SCHEMA))
    assert {r.thread_key for r in touched.collect()} == {"msg:r", "msg:b"}
    assert {r.id: r.thread_key for r in grown.keys().collect()} == {1: "msg:b", 2: "msg:r", 3: "msg:d", 4: "msg:r"}
    assert not changes
    grown.add(2, spark.createDataFrame([], SCHEMA))
    assert grown.threads().count() == 3
