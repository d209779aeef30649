"""Rule tables for the input rules (Q1-Q5, D3) including the traps of SURVEY §2.13."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from carrierbook.functions import rules as R
from carrierbook.functions.receipt_no import pad_number, receipt_number
from carrierbook.functions.text import js_trim, trim_to_null
from carrierbook.sources import schema as S


def _eval(spark, values, *exprs):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return [tuple(r) for r in df.select(*[e(F.col("v")) for e in exprs]).collect()]


PLATES = [
    (None, None, S.ERR_PLATE_REQUIRED), ("   ", None, S.ERR_PLATE_REQUIRED), ("HH-12", None, S.ERR_PLATE_DASH),
    ("HH 12", None, S.ERR_PLATE_SPACE), ("HH 12", None, S.ERR_PLATE_SPACE), ("H!", None, S.ERR_PLATE_CHARS),
    ("ab", "AB", S.ERR_PLATE_SHORT), (" hh12 ", "HH12", None), ("\tkö123\n", "KÖ123", None), ("hh12\n", "HH12", None),
]


@pytest.mark.parametrize("raw,value,err", PLATES)
def test_plate_rule(spark, raw, value, err):
    (v, e), = _eval(spark, [raw], R.plate_value, R.plate_error)
    assert e == err
    if value is not None:
        assert v == value


@pytest.mark.parametrize("raw,value,ok", [(None, "euro", True), ("", "euro", True), ("H1 ", "h1", True),
                                          ("GitterBox", "gitterbox", True), (" ", "", False), ("wood", "wood", False)])
def test_product_rule(spark, raw, value, ok):
    (v, e), = _eval(spark, [raw], R.product_value, R.product_error)
    assert v == value and (e is None) == ok


@pytest.mark.parametrize("raw,value,ok", [(None, None, True), ("  ", None, True), ("a7", "A7", True),
                                          ("abc", "ABC", False), ("A!", "A!", False), ("A5\n", "A5", True)])
def test_employee_code_rule(spark, raw, value, ok):
    (v, e), = _eval(spark, [raw], R.employee_code_value, R.employee_code_error)
    assert v == value and (e is None) == ok


def test_employee_code_dollar_trap(spark):
    # '$' in Java regex matches before a final newline; the rule uses \z.
    df = spark.createDataFrame([("A5\n",)], "v string")
    assert df.select(F.col("v").rlike(R.EMPLOYEE_CODE_PATTERN)).first()[0] is False


@pytest.mark.parametrize("raw,value,ok", [(None, None, True), (" A@B.DE ", "a@b.de", True), ("bad@mail", "bad@mail", False),
                                          ("a b@c.de", "a b@c.de", False), ("x@y.z", "x@y.z", True)])
def test_email_rule(spark, raw, value, ok):
    (v, e), = _eval(spark, [raw], R.email_value, R.email_error)
    assert v == value and (e is None) == ok


def test_js_trim_and_trim_to_null(spark):
    rows = _eval(spark, ["\t x  ", "﻿", None, " a b "], js_trim, trim_to_null)
    assert rows == [("x", "x"), ("", None), (None, None), ("a b", "a b")]


def test_pad_does_not_cut(spark):
    df = spark.createDataFrame([(5,), (1234567,)], "n long")
    assert [r[0] for r in df.select(pad_number(F.col("n"))).collect()] == ["000005", "1234567"]


@pytest.mark.parametrize("name,loc_id,expected", [
    ("Berlin 12", 3, "ICSB12-20240201-000042"), ("über 7", 9, "ICSB7-20240201-000042"),
    ("123", 4, "ICSL123-20240201-000042"), (None, 8, "ICSL8-20240201-000042"), ("Ölhafen", 2, "ICSÖ2-20240201-000042"),
])
def test_receipt_number(spark, name, loc_id, expected):
    df = spark.createDataFrame([(name, loc_id)], "name string, id int")
    got = df.select(receipt_number(F.col("name"), F.col("id"), F.lit(dt.date(2024, 2, 1)), F.lit(42))).first()[0]
    assert got == expected


def test_like_wildcards_not_escaped_by_default(spark):
    from carrierbook.functions.text import contains_ci
    df = spark.createDataFrame([("HH_1",), ("HHx1",)], "v string")
    assert df.where(contains_ci("v", "h_1")).count() == 2
    assert df.where(contains_ci("v", "h_1", escape=True)).count() == 1
