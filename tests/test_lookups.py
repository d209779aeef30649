"""Cases and receipts meet their dimensions without a task that holds all rows of one department, partner or clerk."""

from pyspark.sql import functions as F

from carrierbook.operators import cases, receipts, skew
from carrierbook.session import QUERY_CONF


def bound(spark):
    for name, value in QUERY_CONF.items():
        spark.conf.set(name, value)


def all_cases(spark, n):
    """Cases of few departments, partners and clerks; a third has no clerk yet, a seventh no partner, a ninth no department."""
    return spark.range(1, n + 1, numPartitions=4).selectExpr(
        "cast(id as int) id", "cast(id % 2 + 1 as int) location_id", "cast(if(id % 9 = 0, null, id % 4 + 1) as int) department_id",
        "cast(id as int) created_by", "cast(if(id % 3 = 0, null, id % 2 + 5) as int) claimed_by", "cast(null as int) submitted_by",
        "cast(8 as int) approved_by", "4 status", "concat('R', id) receipt_no", "timestamp_ntz'2024-01-01 00:00:00' created_at",
        "'HH1' license_plate", "if(id % 7 = 0, null, concat('partner ', id % 3)) entrepreneur", "'n' note", "3 qty_in", "1 qty_out",
        "0 non_exchangeable_qty", "'A7' employee_code", "'euro' product_type", "false translogica_transferred")


def dimensions(spark):
    """Departments derived from many rows (five in all), and users and partners too large to broadcast."""
    departments = spark.range(400_000).selectExpr("cast(id % 5 + 1 as int) id", "concat('d', id % 5 + 1) name").distinct()
    locations = spark.createDataFrame([(1, "one"), (2, "two")], "id int, name string")
    users = spark.range(1, 60_001).selectExpr("cast(id as int) id", "concat('user ', id) username")
    partners = spark.range(60_000).selectExpr("concat('partner ', id) name", "concat('street ', id) street", "'1' postal_code", "'c' city")
    return departments, locations, users, partners


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_case_receipts_are_not_gathered_by_department_or_partner(spark):
    bound(spark)
    departments, locations, users, partners = dimensions(spark)
    got = receipts.case_receipts(all_cases(spark, 900), users, locations, departments, partners)
    assert "hashpartitioning(department_id" not in plan(got)
    assert "hashpartitioning(entrepreneur#" in plan(got) and ", _salt#" in plan(got)
    rows = {r["case_id"]: r for r in got.collect()}
    assert len(rows) == got.count() == 900
    for k, r in rows.items():
        assert r["department"] == ("(gelöschte Abteilung)" if k % 9 == 0 else f"d{k % 4 + 1}") and r["aviso_created_by"] == f"user {k}"
        assert r["entrepreneur_street"] == (None if k % 7 == 0 else f"street {k % 3}") and r["location"] == ("one", "two")[k % 2]


def test_cases_of_few_clerks_are_dealt_before_they_meet_the_users(spark):
    bound(spark)
    departments, locations, users, _ = dimensions(spark)
    for large in (False, True):
        got = cases.enrich_cases(all_cases(spark, 900), departments, locations, users, large_users=large)
        assert "hashpartitioning(department_id" not in plan(got) and "_salt" in plan(got)
        rows = {r["id"]: r for r in got.collect()}
        assert len(rows) == got.count() == 900
        for k, r in rows.items():
            assert r["department"] == ("(gelöschte Abteilung)" if k % 9 == 0 else f"d{k % 4 + 1}") and r["created_by_name"] == f"user {k}"
            assert r["claimed_by_name"] == ("(gelöscht)" if k % 3 == 0 else f"user {k % 2 + 5}") and r["approved_by_name"] == "user 8"
            assert r["submitted_by_name"] == "(gelöscht)"


def test_rows_without_a_key_are_dealt_as_heavy_ones(spark):
    long = spark.range(1000).selectExpr("id", "cast(if(id < 600, null, id) as int) k", "cast(if(id < 500, 3, id) as int) j")
    keyed = spark.createDataFrame([(3, "a"), (3, "b"), (700, "c"), (None, "d")], "k int, v string")
    heavy = skew.heavy_keys(long, ["k", "j"])
    assert heavy == {"k": [None], "j": [3]}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = skew.join_salted(long, keyed.hint("merge"), "k", heavy["k"], ["id"])
        parts = got.where("k is null").select(F.spark_partition_id()).distinct().count()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert parts > 1 and got.count() == 1000 and [r["v"] for r in got.where("v is not null").collect()] == ["c"]
    twice = skew.join_salted(long, keyed.withColumnRenamed("k", "j"), "j", heavy["j"], ["id"])
    assert twice.count() == 1500 and {r["v"] for r in twice.where("j = 3").select("v").distinct().collect()} == {"a", "b"}


def test_a_table_is_small_by_what_it_holds(spark):
    assert skew.is_small(spark.range(400_000).selectExpr("id % 5 id").distinct()) and skew.is_small(spark.range(0))
    assert not skew.is_small(spark.range(100_000))


def test_lines_are_ranked_alike_in_crowded_and_other_receipts(spark):
    lines = spark.range(600).selectExpr("id", "if(id % 11 = 0, null, concat('R', id % 5)) receipt_no", "cast(if(id % 4 = 0, null, 9 - id % 3) as int) line_no",
                                        "if(id % 2 = 0, 'IN', 'OUT') type", "cast(id % 6 as int) quantity")
    lines = lines.unionByName(spark.range(7).selectExpr("1000 - id id", "'one' receipt_no", "cast(null as int) line_no", "'IN' type", "1 quantity"))
    plain = receipts.receipt_lines(lines)
    assert "RangePartition" not in plan(plain) and "Scan ExistingRDD" not in plan(plain)
    rows = sorted(tuple(r) for r in plain.select("receipt_no", "position", "id", "type", "quantity").collect())
    want, by = [], {}
    for r in lines.where("receipt_no is not null").collect():
        by.setdefault(r["receipt_no"], []).append((999999 if r["line_no"] is None else r["line_no"], r["id"], r["type"], r["quantity"]))
    for k, found in by.items():
        want += [(k, n, i, t, q) for n, (_, i, t, q) in enumerate(sorted(found), 1)]
    assert rows == sorted(want)
    # Receipts of more than 50 lines are numbered by ranges, the small one is not.
    mixed = receipts.receipt_lines(lines, crowded=50)
    assert sorted(tuple(r) for r in mixed.select("receipt_no", "position", "id", "type", "quantity").collect()) == rows
    assert mixed.dtypes == plain.dtypes
