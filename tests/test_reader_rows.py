"""Readers' rows: made distinct before they are written out, and written out for who reads them, not in every batch."""

import random

from pyspark.sql import functions as F

from carrierbook.operators import audience
from carrierbook.streaming.live_cases import LiveCases
from tests.test_live_cases import _batch, _case, _live, _steps


def test_each_notice_of_a_reader_once_equals_the_distinct_rows(spark):
    rnd = random.Random(11)
    ids = [1, 2, 3, None]
    notices = spark.createDataFrame(
        [(rnd.choice([1, 2, 3, 4, 5, None]), rnd.choice(["a", "b", None]), rnd.choice(["location", "department", "user", "user", None]),
          rnd.choice(ids), rnd.choice([None, 1, 2, 3]), "m") for _ in range(120)],
        "case_id int, title string, audience string, audience_id int, except_user int, message string")
    # A reader may be of several places, be listed twice or have no id.
    members = spark.createDataFrame([("location", 1, 1), ("location", 1, 1), ("location", 2, 1), ("department", 1, 1), ("location", 2, 2),
                                     ("department", 3, 2), ("department", 3, None), ("location", 1, None), ("user", 1, 1), ("user", 2, 2),
                                     ("user", 3, 3), ("department", 2, 3)], "audience string, audience_id int, user_id int")
    for some in (None, spark.createDataFrame([(1,), (3,)], "user_id int")):
        for seed in range(3):
            part = notices.where(F.pmod(F.xxhash64("case_id", "title", "audience", "audience_id"), F.lit(3)) != seed)
            want = {tuple(r) for r in audience.for_readers(part, members, some).select("user_id", "case_id", "title").collect()}
            got = [tuple(r) for r in audience.for_readers(part, members, some, once=True).collect()]
            assert want and set(got) == want and len(got) == len(want)


def test_a_department_notice_is_written_out_by_many_tasks_and_not_compared(spark):
    notices = spark.createDataFrame([(k, "t", "department", 4, k % 10, "m") for k in range(200)],
                                    "case_id int, title string, audience string, audience_id int, except_user int, message string").coalesce(1)
    members = spark.createDataFrame([("department", 4, k) for k in range(10)], "audience string, audience_id int, user_id int").coalesce(1)
    got = audience.for_readers(notices, members, once=True)
    assert got.count() == 200 * 9
    assert got.select(F.spark_partition_id()).distinct().count() > 1
    # The rows written out meet no aggregate: the plan's top is the union of its parts, the first of them a plain join.
    top = got._jdf.queryExecution().optimizedPlan()
    assert top.nodeName() == "Union" and top.children().apply(0).nodeName() != "Aggregate"


def test_a_batch_keeps_notices_by_audience_and_events_give_the_readers_rows(spark, tmp_path):
    n = 4
    log = _steps(*[(i, a, {}) for i in range(1, n + 1) for a in ("claim", "submit")])
    live = _live(spark, tmp_path, [_case(i) for i in range(1, n + 1)])
    live(_batch(spark, log), 0)
    kept = spark.read.parquet(live.store.place("events", 0))
    assert kept.where("user_id is not null").count() == 0
    assert spark.read.parquet(live.store.place("notice-changes", 0)).count() == n
    events = live.events(0)
    assert events.columns == kept.columns
    rows = events.where("user_id is not null").collect()
    # Readers 10 and 11 are of department 2; each is told of every case, numbered from 1 in the order of the cases.
    assert sorted((r["channel"], r["event"], r["case_id"], r["n"], r["batch"]) for r in rows) == sorted(
        (f"user:{u}", "notificationCreated", i, i, 0) for u in (10, 11) for i in range(1, n + 1))
    other = events.where("user_id is null")
    assert "Join" not in other._jdf.queryExecution().optimizedPlan().toString() and other.count() == kept.count() == n


def test_untouched_cases_are_compared_only_where_an_id_repeats_or_is_null(spark):
    cases = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (None, "d"), (3, "e")], "id int, note string")
    found = LiveCases._indistinct(cases, cases.where("id is null or id <> 1"))
    assert sorted((r["note"] for r in found.collect())) == ["b", "c", "d"]
    assert LiveCases._indistinct(cases.where("id in (1, 3)"), cases.where("id = 3")).count() == 0
