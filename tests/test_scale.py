"""What keeps the large queries within a task's and the driver's memory: spread fan-outs, inboxes by rank, salted actors."""

import datetime as dt
import random

from pyspark.sql import functions as F

from carrierbook.operators import audience, deletes, notify, payload_replay
from carrierbook.plans import catalog
from carrierbook.session import QUERY_CONF
from tests.conftest import SF_SMALL

USERS = ("id int, username string, role string, location_id int, role_id int, is_active boolean, fixed_department_id int")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_newest_notices_of_readers_equal_the_whole_expansion(spark):
    rnd = random.Random(5)
    notices = spark.createDataFrame(
        [(k // 2, rnd.choice("ab"), rnd.choice(["location", "department"]), rnd.choice([1, 2, None]),
          7 if k % 3 else rnd.choice([None, 1, 2, 3, 8]), "m") for k in range(300)],
        "case_id int, title string, audience string, audience_id int, except_user int, message string")
    members = spark.createDataFrame([("location", 1, 7), ("department", 2, 7), ("location", 1, 8), ("location", 2, 1), ("location", 2, 1),
                                     ("department", 1, 2), ("department", 9, 3)], "audience string, audience_id int, user_id int")
    readers = spark.createDataFrame([(7,), (8,), (1,), (1,), (3,)], "user_id int")
    want = {}
    for user, case, title in audience.for_readers(notices, members, readers).select("user_id", "case_id", "title").collect():
        want.setdefault(user, []).append((case, title))
    want = sorted((user, *pair) for user, pairs in want.items() for pair in sorted(pairs, key=lambda p: (-p[0], p[1]))[:5])
    assert want and sorted(tuple(r) for r in audience.newest_for_readers(notices, members, readers, 5).collect()) == want


def test_a_department_with_all_cases_is_fanned_out_by_many_tasks(spark):
    users = spark.createDataFrame([(k, f"u{k}", "disponent", 1, None, True, 4) for k in range(1, 11)], USERS)
    cases = spark.createDataFrame([(k, 1, 4, 3, 2) for k in range(1, 201)],
                                  "id int, location_id int, department_id int, created_by int, submitted_by int").coalesce(1)
    names = spark.createDataFrame([(4, "four")], "id int, name string").coalesce(1)
    got = notify.department_fanout(cases, users.coalesce(1), names)
    assert got.count() == 200 * 9 and got.where("user_id = 2").count() == 0
    assert got.select(F.spark_partition_id()).distinct().count() > 1
    # The creator is excepted at a location; a place without a name is called by its number.
    place = notify.location_fanout(cases, users.coalesce(1), names)
    assert place.count() == 200 * 9 and place.where("user_id = 3 or message not like '%Standort 1%'").count() == 0
    assert place.select(F.spark_partition_id()).distinct().count() > 1


def test_the_actions_of_one_actor_are_dealt_to_many_parts(spark):
    at = dt.datetime(2024, 1, 1)
    log = spark.createDataFrame([(k, k, 1 if k < 900 else None, "claim", at) for k in range(1000)],
                                "action_id int, case_id int, actor_id int, action string, ts timestamp_ntz")
    cases = spark.createDataFrame([(k, 1, 1, 0, 0, None) for k in range(1000)],
                                  "id int, location_id int, status int, qty_in int, qty_out int, employee_code string")
    rights = spark.createDataFrame([(1, None, True, True)], "actor_id int, _lock int, _p_cases_claim boolean, _p_cases_require_employee_code boolean")
    for p in ("cases_edit", "cases_submit", "cases_approve", "bookings_translogica", "cases_cancel"):
        rights = rights.withColumn("_p_" + p, F.lit(False))
    facts = payload_replay._facts(log, cases, rights)
    assert facts.count() == 1000 and facts.where("_perm").count() == 900
    # Without salts no second key takes part in the join with the rights.
    assert "_salt" in facts._jdf.queryExecution().optimizedPlan().toString()


def test_queries_bound_what_is_broadcast_and_read_by_a_task(spark):
    catalog.run(spark, SF_SMALL, "list_locations")
    assert {k: spark.conf.get(k) for k in QUERY_CONF} == QUERY_CONF


def test_lines_of_a_deleted_user_are_counted_before_they_are_shuffled(spark):
    granted = spark.createDataFrame([("user", 1), ("user", 1), ("user", 9), ("role", 2)], "kind string, target_id int")
    many = spark.createDataFrame([(k, 1 if k % 4 else None) for k in range(400)], "id int, user_id int")
    blank = {c: F.lit(None).cast("int") for c in ("location_id", "department_id", "created_by", "claimed_by", "submitted_by", "approved_by",
                                                  "case_id", "fixed_department_id")}
    wide = many.withColumns(blank)
    roles = spark.sql("select 1 id union all select 2")
    tables = {n: wide for n in ("booking_cases", "user_notifications", "users", "bookings")} | {n: roles for n in deletes.KINDS}
    got = deletes.effects(granted, tables | {n: roles for n in ("roles", "locations", "departments", "entrepreneurs")})
    assert {tuple(r) for r in got.where("n > 0").collect()} == {
        ("users", "id", "delete", 2), ("user_notifications", "user_id", "delete", 300), ("bookings", "user_id", "set null", 300),
        ("roles", "id", "delete", 1)} and got.count() == sum(map(len, deletes.EFFECTS.values()))
    got.write.format("noop").mode("overwrite").save()
    assert "BroadcastNestedLoopJoin" not in got._jdf.queryExecution().executedPlan().toString()
