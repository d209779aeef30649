"""Batches that hold several rows for one key, and ledger lines that arrive late."""

import datetime as dt
import os

from pyspark.sql import functions as F

from carrierbook.operators import lifecycle, maintain
from carrierbook.streaming import case_feed
from carrierbook.streaming.live_stock import StockTable

TABLE = "id int, name string, street string, city string"
ROWS = [(1, "a", "s1", "c1"), (2, "b", "s2", "c2"), (3, "c", None, None)]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_coalesce_patches_of_one_key_apply_in_order(spark):
    patches = spark.createDataFrame([(1, 1, "x", None), (1, 2, None, "y"), (1, 3, "z", None), (9, 4, "q", "q")],
                                    "id int, seq int, street string, city string")
    got = maintain.coalesce_patch(spark.createDataFrame(ROWS, TABLE), patches, columns=["street", "city"])
    assert rows(got) == [(1, "a", "z", "y"), (2, "b", "s2", "c2"), (3, "c", None, None)]


def test_masked_patches_of_one_key_apply_in_order(spark):
    patches = spark.createDataFrame([(1, 1, "street,city", "x", "x"), (1, 2, "city", "ignored", None), (2, 3, "", "q", "q")],
                                    "id int, seq int, present string, street string, city string")
    got = maintain.masked_patch(spark.createDataFrame(ROWS, TABLE), patches, columns=["street", "city"])
    assert rows(got) == [(1, "a", "x", None), (2, "b", "s2", "c2"), (3, "c", None, None)]


def test_patches_without_an_order_column_keep_one_row_per_key(spark):
    patches = spark.createDataFrame([(1, "x"), (1, "y")], "id int, street string")
    got = maintain.coalesce_patch(spark.createDataFrame(ROWS, TABLE), patches, columns=["street"])
    assert rows(got.where("id = 1")) == [(1, "a", "y", "c1")]


def test_the_last_replacement_of_a_row_holds(spark):
    new = spark.createDataFrame([(1, 1, "n1", "x", "x"), (1, 2, "n2", None, "y"), (7, 3, "n3", "x", "x")],
                                "id int, seq int, name string, street string, city string")
    got, bad = maintain.replace_by_id(spark.createDataFrame(ROWS, TABLE), new, columns=["name", "street", "city"])
    assert rows(got) == [(1, "n2", None, "y"), (2, "b", "s2", "c2"), (3, "c", None, None)]
    assert [r["id"] for r in bad.collect()] == [7]


def _cases(spark, ledger):
    """Three announced cases and a booked one, with a transfer flag."""
    some = ledger.booking_cases.withColumn("translogica_transferred", F.lit(False)).limit(4).collect()
    changed = [r.asDict() | {"id": k + 1, "status": 4 if k == 3 else 1, "claimed_by": None, "submitted_by": None, "approved_by": None,
                             "receipt_no": None, "qty_in": 10, "qty_out": 2, "non_exchangeable_qty": 0, "employee_code": None}
               for k, r in enumerate(some)]
    schema = ledger.booking_cases.withColumn("translogica_transferred", F.lit(False)).schema
    return spark.createDataFrame([tuple(r[c] for c in schema.names) for r in changed], schema)


def _actions(spark):
    at = dt.datetime(2024, 1, 1, 8)
    steps = [(1, "claim", None, None, None), (1, "submit", 3, "B7", None), (1, "approve", None, None, None),
             (1, "set_translogica", None, None, True), (2, "claim", None, None, None), (2, "submit", None, None, None),
             (2, "claim", None, None, None), (4, "set_translogica", None, None, True), (4, "set_translogica", None, None, False),
             (4, "set_translogica", None, None, True)]
    return spark.createDataFrame(
        [(k + 1, case, 1, action, at + dt.timedelta(minutes=k), nonx, code, flag)
         for k, (case, action, nonx, code, flag) in enumerate(steps)],
        "action_id int, case_id int, actor_id int, action string, ts timestamp_ntz, non_exchangeable_qty int, "
        "employee_code string, translogica_transferred boolean")


def test_a_batch_with_several_actions_per_case_keeps_one_row_per_case(spark, ledger):
    cases = _cases(spark, ledger)
    new, rejects = lifecycle.apply_batch(_actions(spark), cases, ledger.users, ledger.roles)
    by_id = {r["id"]: r for r in new.collect()}
    assert new.count() == 4 and set(by_id) == {1, 2, 3, 4}
    one, two, four = by_id[1], by_id[2], by_id[4]
    assert (one["status"], one["claimed_by"], one["submitted_by"], one["approved_by"]) == (4, 1, 1, 1)
    assert (one["non_exchangeable_qty"], one["employee_code"], one["translogica_transferred"]) == (3, "B7", True)
    assert (two["status"], two["applied_action"], two["approved_by"]) == (3, "submit", None)
    assert by_id[3]["applied_action"] is None and four["translogica_transferred"] is True
    assert [r["action_id"] for r in rejects.collect()] == [7]


def test_advance_cases_keeps_payloads_and_the_flag(spark, ledger):
    new, _ = case_feed.advance_cases(_cases(spark, ledger), _actions(spark), ledger.users, ledger.roles)
    one = new.where("id = 1").first()
    assert (one["status"], one["non_exchangeable_qty"], one["employee_code"], one["translogica_transferred"]) == (4, 3, "B7", True)


def test_an_approval_posts_the_quantities_its_submit_set(spark, ledger):
    new, lines, _ = lifecycle.commit_batch(_actions(spark), _cases(spark, ledger), ledger.users, ledger.roles, ledger.locations,
                                           receipt_start=5, day=dt.date(2024, 1, 1))
    assert sorted((r["type"], r["quantity"]) for r in lines.collect()) == [("IN", 7), ("OUT", 2)]
    assert new.where("id = 1").first()["receipt_no"] is not None


def test_live_stock_counts_lines_that_arrive_late(spark, tmp_path):
    schema = "id long, location_id int, department_id int, product_type string, type string, quantity int, created_at timestamp_ntz"
    day = dt.datetime(2024, 5, 1)
    deliveries = [[(1, 10, day)], [(2, 1, day + dt.timedelta(days=30)), (1, 10, day)], [(3, 100, day - dt.timedelta(days=90))]]
    table = StockTable(spark, str(tmp_path / "table"))
    for k, lines in enumerate(deliveries):
        spark.createDataFrame([(i, 1, 1, "euro", "IN", n, at) for i, n, at in lines], schema).write.parquet(
            os.path.join(str(tmp_path), "feed", str(k)))
        feed = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "feed"))
        table.start(feed, str(tmp_path / "ck")).awaitTermination()
    assert [r["ins"] for r in table.current().collect()] == [111]
