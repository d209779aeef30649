"""Properties: balances, posting, idempotent upserts, exports, chunked lists,
and stream = batch for the live stock and live case state."""

import os
import tempfile

from pyspark.sql import functions as F

from carrierbook.operators import balance, maintain, notify, posting
from carrierbook.sources import export
from carrierbook.streaming import live_stock
from carrierbook.streaming.case_feed import LiveCaseState, advance_cases


def test_saldo_and_location_totals_add_up(ledger):
    per_loc = balance.stock(ledger.bookings, mode="location_total", product="euro", locations=ledger.locations)
    assert per_loc.where(F.col("saldo") != F.col("ins") - F.col("outs")).count() == 0
    tot = per_loc.agg(F.sum("ins"), F.sum("outs")).first()
    b = ledger.bookings.where(F.col("product_type").isNull() | (F.col("product_type") == "euro"))
    whole = b.agg(F.sum(F.when(F.col("type") == "IN", F.col("quantity"))),
                  F.sum(F.when(F.col("type") == "OUT", F.col("quantity")))).first()
    assert tuple(tot) == tuple(whole)


def test_overall_has_zero_row_for_unused_department(ledger):
    rows = {r["department"]: r for r in balance.stock(ledger.bookings, mode="overall", departments=ledger.departments).collect()}
    assert (rows["UNUSED"]["ins"], rows["UNUSED"]["outs"], rows["UNUSED"]["saldo"]) == (0, 0, 0)


def test_posting_lines_equal_clamped_quantities(ledger):
    c = ledger.booking_cases.where(F.col("status") == 3).withColumn("approved_by", F.lit(1))
    numbered = posting.assign_receipt_numbers(c, ledger.locations, order=["id"], start=1)
    lines = posting.post_cases(numbered)
    got = lines.groupBy("case_id").agg(F.sum(F.when(F.col("type") == "IN", F.col("quantity"))).alias("i"),
                                       F.sum(F.when(F.col("type") == "OUT", F.col("quantity"))).alias("o"),
                                       F.max("line_no").alias("n"), F.countDistinct("booking_group_id").alias("g"))
    want = c.select(F.col("id").alias("case_id"),
                    F.greatest(F.col("qty_in") - F.col("non_exchangeable_qty"), F.lit(0)).alias("wi"),
                    F.col("qty_out").alias("wo"))
    j = want.join(got, "case_id", "left")
    bad = j.where((F.coalesce(F.col("i"), F.lit(0)) != F.col("wi")) | (F.coalesce(F.col("o"), F.lit(0)) != F.col("wo"))
                  | (F.coalesce(F.col("n"), F.lit(0)) != (F.col("wi") > 0).cast("int") + (F.col("wo") > 0).cast("int")))
    assert bad.count() == 0
    assert lines.where(F.col("g") if "g" in lines.columns else F.lit(False)).count() == 0
    assert numbered.select("receipt_seq").distinct().count() == c.count()


def test_upsert_twice_equals_once(ledger):
    once, _ = maintain.upsert_keep_old(ledger.entrepreneurs, ledger.partner_updates)
    twice, _ = maintain.upsert_keep_old(once, ledger.partner_updates)
    assert once.exceptAll(twice).count() == 0 and twice.exceptAll(once).count() == 0


def test_prune_sends_null_case_ids_to_deleted(ledger):
    kept, deleted = notify.prune(ledger.user_notifications, ledger.booking_cases)
    assert kept.where(F.col("case_id").isNull()).count() == 0
    assert kept.count() + deleted.count() == ledger.user_notifications.count()


def test_id_lists_are_chunked(ledger):
    parts = notify.ids_by_user(ledger.user_notifications, chunk=3)
    assert parts.where(F.size("notification_ids") > 3).count() == 0
    flat = parts.select(F.explode("notification_ids").alias("id"))
    assert flat.exceptAll(ledger.user_notifications.select("id")).count() == 0
    assert flat.count() == ledger.user_notifications.count()


def test_export_written_and_read_back(spark, ledger):
    rows = export.export_ledger(ledger.bookings, ledger.users, ledger.locations, ledger.departments, 3, 2)
    out = tempfile.mkdtemp(prefix="cb-export-")
    export.write_csv(rows, os.path.join(out, "csv"))
    back = spark.read.option("header", True).csv(os.path.join(out, "csv"))
    assert back.columns == ["id"] + export.EXPORT_FIELDS
    assert back.count() == rows.count()
    assert set(export.labelled(rows).columns) == set(export.EXPORT_LABELS.values())


def test_live_stock_stream_equals_batch(spark, ledger):
    src = tempfile.mkdtemp(prefix="cb-feed-")
    b = ledger.bookings
    for i in range(3):   # the feed arrives as three files
        b.where(F.col("id") % 3 == i).coalesce(1).write.mode("overwrite").parquet(os.path.join(src, f"part{i}"))
    feed = spark.readStream.schema(b.schema).option("recursiveFileLookup", True).parquet(src)
    q = (live_stock.live_stock(feed, dedup_key=None).writeStream.outputMode("complete").format("memory")
         .queryName("t1_stream").option("checkpointLocation", tempfile.mkdtemp(prefix="cb-ck-"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    got = spark.table("t1_stream")
    want = live_stock.live_stock(b, dedup_key=None)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_live_stock_drops_redelivered_lines(spark):
    rows = [(1, 1, 1, "euro", "IN", 5, "2024-01-01 00:00:00"), (1, 1, 1, "euro", "IN", 5, "2024-01-01 00:00:00"),
            (2, 1, 1, "euro", "OUT", 2, "2024-01-01 00:01:00")]
    df = spark.createDataFrame(rows, "id long, location_id int, department_id int, product_type string, type string, "
                                     "quantity int, created_at string").withColumn("created_at", F.to_timestamp("created_at"))
    r = live_stock.live_stock(df, dedup_key="id").first()
    assert (r["ins"], r["outs"], r["saldo"]) == (5, 2, 3)


def test_live_case_state_stream_equals_replay(spark, ledger):
    acts = ledger.case_actions
    src = tempfile.mkdtemp(prefix="cb-actions-")
    cut = acts.agg(F.percentile_approx("ts", 0.5)).first()[0]
    acts.where(F.col("ts") < cut).write.mode("overwrite").parquet(os.path.join(src, "a"))
    state_dir = tempfile.mkdtemp(prefix="cb-state-")
    runner = LiveCaseState(spark, ledger.booking_cases, ledger.users, ledger.roles, state_dir)
    stream = spark.readStream.schema(acts.schema).option("recursiveFileLookup", True).parquet(src)
    ck = tempfile.mkdtemp(prefix="cb-ck-")
    runner.start(stream, ck).awaitTermination()
    acts.where(F.col("ts") >= cut).write.mode("overwrite").parquet(os.path.join(src, "b"))
    # a fresh runner (as after a driver restart) resumes from the last committed batch
    runner = LiveCaseState(spark, None, ledger.users, ledger.roles, state_dir, schema=ledger.booking_cases.schema)
    runner.start(spark.readStream.schema(acts.schema).option("recursiveFileLookup", True).parquet(src), ck).awaitTermination()
    once, _ = advance_cases(ledger.booking_cases, acts, ledger.users, ledger.roles)
    cols = ["id", "status", "claimed_by", "submitted_by", "approved_by"]
    got = runner.current().select(*cols)
    assert got.exceptAll(once.select(*cols)).count() == 0


def test_company_export_one_folder_per_pair(spark, ledger):
    out = os.path.join(tempfile.mkdtemp(prefix="cb-company-"), "ledger")
    export.write_company_export(ledger.bookings, ledger.users, out)
    back = spark.read.parquet(out)
    src = ledger.bookings.where(F.col("department_id").isNotNull())
    assert back.where(F.col("department_id").isNotNull()).count() == src.count()
    assert back.select("location_id", "department_id").distinct().count() == \
        ledger.bookings.select("location_id", "department_id").distinct().count()
    assert set(back.columns) >= set(export.EXPORT_FIELDS)


def test_stored_layout_prunes_location_partitions(spark, ledger):
    from carrierbook.operators import balance
    from carrierbook.sources.fixtures import load_tables, store_tables
    d = tempfile.mkdtemp(prefix="cb-tables-")
    store_tables(ledger, d, ["bookings", "departments"])
    stored = load_tables(spark, d)
    q = balance.stock(stored.bookings, mode="location", location_id=3, departments=stored.departments)
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(location_id" in plan and "(location_id#" in plan
    want = balance.stock(ledger.bookings, mode="location", location_id=3, departments=ledger.departments)
    assert q.exceptAll(want).count() == 0 and want.exceptAll(q).count() == 0


def test_validate_first_failing_rule(spark):
    from carrierbook.functions import rules as R
    from carrierbook.operators import quality
    df = spark.createDataFrame([(" hh12 ", "H1 "), ("HH-1", "wood"), ("ab", None)], "plate string, product string")
    ok, bad = quality.validate(df, [R.plate_error("plate"), R.product_error("product")])
    assert ok.count() == 1
    assert sorted(r["reason"] for r in bad.collect()) == sorted(["Kennzeichen bitte ohne '-' eingeben", "Kennzeichen zu kurz"])


def test_referenced_ids_guard(ledger):
    from carrierbook.operators import quality
    targets = ledger.departments.select("id")
    used = {r["id"] for r in quality.referenced_ids(targets, ledger.bookings, "department_id").collect()}
    assert 6 not in used and used == {1, 2, 3, 4, 5}


def test_receipt_documents_nest_lines_in_order(ledger):
    from carrierbook.operators import receipts
    lines = receipts.receipt_lines(ledger.bookings)
    heads = receipts.ledger_receipts(ledger.bookings, ledger.booking_cases, ledger.users, ledger.locations,
                                     ledger.departments, ledger.entrepreneurs)
    docs = receipts.receipt_documents(heads, lines, part_size=2)
    assert docs.where(F.size("lines") > 2).count() == 0
    per = docs.groupBy("receipt_no", "line_count").agg(F.sum(F.size("lines")).alias("n"))
    assert per.where(F.col("n") != F.col("line_count")).count() == 0
    tot = docs.select("receipt_no", "qty_in", F.aggregate(
        "lines", F.lit(0), lambda a, x: a + F.when(x["type"] == "IN", x["quantity"]).otherwise(0)).alias("i"))
    tot = tot.groupBy("receipt_no", "qty_in").agg(F.sum("i").alias("i"))
    assert tot.where(F.col("i") != F.col("qty_in")).count() == 0


def test_notice_merge_is_idempotent(ledger):
    created = notify.location_fanout(ledger.booking_cases.where(F.col("status") == 1), ledger.users, ledger.locations)
    first = notify.merge_new(ledger.user_notifications, created)
    existing = ledger.user_notifications.select("user_id", "case_id", "title").unionByName(
        first.select("user_id", "case_id", "title"))
    assert notify.merge_new(existing, created).count() == 0


def test_live_stock_stream_drops_redelivered_lines(spark):
    rows = [(i, 1 + i % 3, 1, "euro", "IN" if i % 4 else "OUT", 1 + i % 5) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, location_id int, department_id int, product_type string, type string, "
                                     "quantity int").withColumn("created_at", F.lit("2024-01-01 10:00:00").cast("timestamp_ntz"))
    src = tempfile.mkdtemp(prefix="cb-redeliver-")
    df.write.mode("overwrite").parquet(os.path.join(src, "first"))
    df.where(F.col("id") < 50).write.mode("overwrite").parquet(os.path.join(src, "again"))  # redelivered lines
    feed = spark.readStream.schema(df.schema).option("recursiveFileLookup", True).parquet(src)
    q = (live_stock.live_stock(feed, dedup_key="id").writeStream.outputMode("complete").format("memory")
         .queryName("t1_dedup").option("checkpointLocation", tempfile.mkdtemp(prefix="cb-ck-"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    got = spark.table("t1_dedup")
    want = live_stock.live_stock(df, dedup_key=None)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_status_zero_is_a_real_filter(ledger):
    from carrierbook.operators import cases
    got = cases.list_cases(ledger.booking_cases, ledger.departments, ledger.locations, ledger.users,
                           location_id=-1, status=0, limit=None)
    assert got.count() == ledger.booking_cases.where(F.col("status") == 0).count() > 0
    assert got.where(F.col("status") != 0).count() == 0


def test_zero_line_approval_still_gets_a_receipt_number(spark, ledger):
    c = ledger.booking_cases.where(F.col("status") == 3).limit(3).withColumns({
        "qty_in": F.lit(2), "qty_out": F.lit(0), "non_exchangeable_qty": F.lit(5), "approved_by": F.lit(1)})
    numbered = posting.assign_receipt_numbers(c, ledger.locations, order=["id"], start=7)
    assert sorted(r["receipt_seq"] for r in numbered.collect()) == [7, 8, 9]
    assert posting.post_cases(numbered).count() == 0


def test_notification_feed_stream_equals_batch(spark):
    """Streamed in two batches, the created notices equal one batch over the whole log."""
    import datetime as dt
    from carrierbook.operators import lifecycle
    from carrierbook.sources import schema as S
    from carrierbook.streaming.case_feed import notification_feed
    users = spark.createDataFrame([(1, "admin", "admin", None, None, True, None)]
                                  + [(i, f"u{i}", "disponent", 1, None, True, 1 + i % 2) for i in range(2, 12)], S.USERS)
    roles = spark.createDataFrame([(1, "x", "{}")], S.ROLES)
    deps = spark.createDataFrame([(1, "A"), (2, "B")], S.DEPARTMENTS)
    cases = spark.createDataFrame(
        [(i, 1, 1 + i % 2, 2, 2, "HH1", None, None, 5, 2, 0, None, "A7", dt.datetime(2024, 1, 1), None, None, None, None)
         for i in range(1, 21)], S.BOOKING_CASES)
    t0 = dt.datetime(2024, 1, 2)
    acts = spark.createDataFrame([(i, i, 1, "submit", t0 + dt.timedelta(minutes=i)) for i in range(1, 21)], S.CASE_ACTIONS)
    notes = spark.createDataFrame([], S.USER_NOTIFICATIONS)
    src = tempfile.mkdtemp(prefix="cb-t2-")
    acts.where(F.col("action_id") <= 10).write.parquet(os.path.join(src, "a"))
    state = tempfile.mkdtemp(prefix="cb-t2-state-")
    ck = tempfile.mkdtemp(prefix="cb-ck-")
    runner = LiveCaseState(spark, cases, users, roles, state, departments=deps, notifications=notes)
    stream = lambda: spark.readStream.schema(acts.schema).option("recursiveFileLookup", True).parquet(src)
    runner.start(stream(), ck).awaitTermination()
    acts.where(F.col("action_id") > 10).write.parquet(os.path.join(src, "b"))
    runner.start(stream(), ck).awaitTermination()
    got = runner.created_notices().select("user_id", "case_id", "title")
    want, _ = notification_feed(lifecycle.replay(acts, cases, users, roles), cases, users, deps, notes)
    want = want.select("user_id", "case_id", "title")
    assert got.count() == want.count() > 0
    assert got.exceptAll(want).count() == 0


def test_stock_table_sink_equals_batch(spark, ledger):
    from carrierbook.streaming.live_stock import StockTable
    b = ledger.bookings
    src = tempfile.mkdtemp(prefix="cb-feed2-")
    b.where(F.col("id") % 2 == 0).write.parquet(os.path.join(src, "a"))
    sink = StockTable(spark, os.path.join(tempfile.mkdtemp(prefix="cb-stock-"), "stock"))
    ck = tempfile.mkdtemp(prefix="cb-ck-")
    feed = lambda: spark.readStream.schema(b.schema).option("recursiveFileLookup", True).parquet(src)
    sink.start(feed(), ck, dedup_key=None).awaitTermination()
    b.where(F.col("id") % 2 == 1).write.parquet(os.path.join(src, "b"))
    sink.start(feed(), ck, dedup_key=None).awaitTermination()
    want = live_stock.live_stock(b, dedup_key=None)
    got = sink.current()
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_offset_and_keyset_pages_agree_with_full_order(ledger):
    from carrierbook.operators import receipts
    r = receipts.receipt_rollup(ledger.bookings, ledger.booking_cases, ledger.users, department_id=1, location_id=-1)
    full = [row["id"] for row in r.orderBy(F.col("id").desc(), F.col("receipt_no").asc_nulls_last()).collect()]
    order = [F.col("id").desc(), F.col("receipt_no").asc_nulls_last()]
    seen, offset = [], 0
    while True:
        page = receipts.page(r, order, limit=7, offset=offset).collect()
        ids = [row["id"] for row in sorted(page, key=lambda x: -x["id"])]
        seen += ids
        more = {row["has_more"] for row in page}
        assert more <= {len(full) > offset + 7}
        if len(full) <= offset + 7:
            break
        offset += 7
    assert seen == full
    first = [row["id"] for row in receipts.page(r, order, limit=7, offset=0).collect()]
    after = receipts.page_after(r, "id", min(first), limit=7).collect()
    second = receipts.page(r, order, limit=7, offset=7).collect()
    assert sorted(x["id"] for x in after) == sorted(x["id"] for x in second)


def test_page_limits_are_clamped():
    from carrierbook.operators.receipts import clamp_page
    assert clamp_page(0, -5) == (1, 0)
    assert clamp_page(1000, 3) == (100, 3)
    assert clamp_page(None, None) == (20, 0)


def test_single_case_read_respects_lock(ledger):
    from carrierbook.operators import cases
    keys = ledger.case_actions.select("case_id")
    all_rows = cases.get_cases(ledger.booking_cases, ledger.departments, ledger.locations, ledger.users, keys)
    locked = cases.get_cases(ledger.booking_cases, ledger.departments, ledger.locations, ledger.users, keys,
                             lock_location=3)
    assert locked.where(F.col("location_id") != 3).count() == 0
    assert locked.count() == all_rows.where(F.col("location_id") == 3).count()


def test_start_live_stock_runner(spark, ledger):
    from carrierbook.streaming.live_stock import start_live_stock
    src = tempfile.mkdtemp(prefix="cb-feed3-")
    ledger.bookings.write.parquet(os.path.join(src, "a"))
    q = start_live_stock(spark, os.path.join(src, "a"), ledger.bookings.schema,
                         tempfile.mkdtemp(prefix="cb-ck-"), query_name="t1_runner", dedup_key=None)
    q.awaitTermination()
    want = live_stock.live_stock(ledger.bookings, dedup_key=None)
    got = spark.table("t1_runner")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
