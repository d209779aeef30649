"""Ledger posting and intake jobs.

All are narrow per-row jobs (validation columns, ``inline`` of a 0-2 element
array) except the numbering (B3), which is range-partitioned numbering over
the whole batch.  Validation keeps the reference's rule order: the first
failing rule is the reject reason.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carrierbook.functions import rules as R
from carrierbook.functions.receipt_no import receipt_number
from carrierbook.functions.text import trim_to_null
from carrierbook.operators import access
from carrierbook.operators.numbering import number_rows
from carrierbook.sources import schema as S

LEDGER_LINE_COLUMNS = ["location_id", "department_id", "user_id", "type", "quantity", "note", "receipt_no",
                       "license_plate", "entrepreneur", "booking_group_id", "line_no", "product_type"]


def group_id(*parts: Column) -> Column:
    """Deterministic UUID-shaped id from the given parts (a retry gives the same id)."""
    h = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4),
                       F.substring(h, 17, 4), F.substring(h, 21, 12))


def assign_receipt_numbers(cases: DataFrame, locations: DataFrame, *, order: list, start: int | Column = 1,
                           day: _dt.date | Column | None = None, out: str = "receipt_no") -> DataFrame:
    """Consecutive receipt numbers from ``start`` in the stated order.

    The number part runs gap-free over the whole batch; the prefix is the
    location indicator of each case's location (D3) and ``day``.
    """
    day_c = day if isinstance(day, Column) else F.lit(day or _dt.date.today())
    numbered = number_rows(cases, order, start=start, out="_seq")
    loc = locations.select(F.col("id").alias("_lid"), F.col("name").alias("_lname"))
    numbered = numbered.join(loc, numbered["location_id"] == loc["_lid"], "left")
    return numbered.withColumn(out, receipt_number(F.col("_lname"), F.col("location_id"), day_c, F.col("_seq"))) \
        .withColumnRenamed("_seq", "receipt_seq").drop("_lid", "_lname")


def post_cases(approved: DataFrame, approver_col: str = "approved_by") -> DataFrame:
    """B1: ledger lines of approved cases (0-2 per case, no shuffle).

    IN = max(qty_in - non_exchangeable_qty, 0) when positive, line 1; OUT =
    qty_out when positive, line 1 or 2.  Both share a group id; case
    attributes are copied; product defaults to euro.
    """
    qin = F.greatest(F.coalesce(F.col("qty_in"), F.lit(0)) - F.coalesce(F.col("non_exchangeable_qty"), F.lit(0)), F.lit(0))
    qout = F.coalesce(F.col("qty_out"), F.lit(0))
    lines = F.filter(F.array(
        F.struct(F.lit("IN").alias("type"), qin.alias("quantity"), F.lit(1).alias("line_no")),
        F.struct(F.lit("OUT").alias("type"), qout.alias("quantity"),
                 F.when(qin > 0, F.lit(2)).otherwise(F.lit(1)).alias("line_no"))),
        lambda x: x["quantity"] > 0)
    gid = group_id(F.lit("case"), F.col("id"), F.col("receipt_no"))
    base = approved.select(
        F.col("id").alias("case_id"), "location_id", "department_id", F.col(approver_col).alias("user_id"),
        "note", "receipt_no", "license_plate", "entrepreneur", gid.alias("booking_group_id"),
        R.product_or_default("product_type").alias("product_type"), lines.alias("_l"))
    return base.select("*", F.inline("_l")).drop("_l").select("case_id", *LEDGER_LINE_COLUMNS)


def ledger_rows(lines: DataFrame, numbered: DataFrame, key: str, number: str, *, first_id: int, first_number: int = 1,
                created_at: str | Column) -> DataFrame:
    """Posted or transferred lines as ledger rows: with ``id`` and ``created_at``, ready to be appended.

    ``numbered`` has consecutive numbers (``number``, from ``first_number``) per ``key``, the case or request of the lines.  Each key owns the
    two ids that its number gives it, so ids need no numbering of their own; a key with one line leaves an id unused, as a
    database sequence does.  ``created_at`` is a column of ``numbered`` or a value for all lines.
    """
    at = F.col(created_at) if isinstance(created_at, str) else created_at
    own = numbered.select(key, F.col(number).alias("_no"), at.alias("created_at"))
    rows = lines.join(own, key)
    line_id = F.lit(first_id) + 2 * (F.col("_no") - F.lit(first_number)) + F.col("line_no") - 1
    return rows.select(line_id.cast("bigint").alias("id"), *[c for c in LEDGER_LINE_COLUMNS], F.col("created_at").cast("timestamp_ntz"), key)


def _actor_table(users: DataFrame, roles: DataFrame, paths: list[str]) -> DataFrame:
    perms = access.permission_columns(users, roles, paths)
    return perms.select(F.col("user_id").alias("actor_id"), access.location_lock(perms).alias("_lock"),
                        *[F.coalesce(F.col(p.replace(".", "_")), F.lit(False)).alias(p.replace(".", "_")) for p in paths])


def _join_actor(req: DataFrame, actors: DataFrame, actor_id: int | None) -> DataFrame:
    """Attach the actor's permissions and lock.

    Requests that carry their own ``actor_id`` join the actor table on it; a
    single actor given as a parameter is looked up once (one row) and added
    as literals, which keeps the plan a plain projection.
    """
    if "actor_id" in req.columns and actor_id is None:
        return req.join(actors, "actor_id", "left")
    row = actors.where(F.col("actor_id") == F.lit(actor_id)).first()
    values = row.asDict() if row is not None else {c: None for c in actors.columns}
    out = req if "actor_id" in req.columns else req.withColumn("actor_id", F.lit(actor_id).cast("int"))
    return out.withColumns({c: F.lit(values[c]).cast(actors.schema[c].dataType)
                            for c in actors.columns if c != "actor_id"})


def _int_ok(c: Column, minimum: int) -> Column:
    return c.isNotNull() & (c >= minimum)


def intake_cases(requests: DataFrame, users: DataFrame, roles: DataFrame, *, actor_id: int | None = None,
                 next_case_id: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """B4 + Q9: validate case requests → (new cases with status 1, partner-log rows, rejects).

    Rule order: permission, location + department, plate, qty_in, qty_out,
    both zero, product, employee code, location lock.  Accepted requests get
    consecutive case ids in request order.
    """
    req = requests
    for c in ("entrepreneur", "note"):
        if c not in req.columns:
            req = req.withColumn(c, F.lit(None).cast("string"))
    req = _join_actor(req, _actor_table(users, roles, ["cases.create"]), actor_id)
    qin = F.coalesce(F.col("qty_in"), F.lit(0))
    qout = F.coalesce(F.col("qty_out"), F.lit(0))
    loc0 = F.coalesce(F.col("location_id"), F.lit(0)) == 0
    dep0 = F.coalesce(F.col("department_id"), F.lit(0)) == 0
    reason = R.first_reason(
        F.when(~F.coalesce(F.col("cases_create"), F.lit(False)), F.lit(S.ERR_NO_PERMISSION)),
        F.when(loc0 | dep0, F.lit(S.ERR_IDS_REQUIRED)),
        R.plate_error("license_plate"),
        F.when(~_int_ok(qin, 0), F.lit(S.ERR_QTY_IN)),
        F.when(~_int_ok(qout, 0), F.lit(S.ERR_QTY_OUT)),
        F.when((qin == 0) & (qout == 0), F.lit(S.ERR_QTY_BOTH_ZERO)),
        R.product_error("product_type"),
        R.employee_code_error("employee_code"),
        F.when(F.col("_lock").isNotNull() & (F.col("location_id") != F.col("_lock")), F.lit(S.ERR_FORBIDDEN)))
    checked = req.withColumn("reason", reason)
    rejects = checked.where(F.col("reason").isNotNull()).select("request_id", "actor_id", "reason")
    ok = checked.where(F.col("reason").isNull()).select(
        "request_id", "location_id", "department_id", F.col("actor_id").alias("created_by"),
        F.lit(S.STATUS_ANNOUNCED).alias("status"), R.plate_value("license_plate").alias("license_plate"),
        trim_to_null("entrepreneur").alias("entrepreneur"), trim_to_null("note").alias("note"),
        qin.alias("qty_in"), qout.alias("qty_out"), F.lit(0).alias("non_exchangeable_qty"),
        R.product_value("product_type").alias("product_type"),
        R.employee_code_value("employee_code").alias("employee_code"))
    cases = number_rows(ok, ["request_id"], start=next_case_id, out="id")
    cases = cases.withColumn("id", F.col("id").cast("int"))
    history = cases.where(F.col("entrepreneur").isNotNull()).select(
        "location_id", "department_id", "created_by", "entrepreneur", "license_plate", "qty_in", "qty_out",
        "product_type", F.col("id").alias("case_id"))
    return cases, history, rejects


def internal_transfers(requests: DataFrame, users: DataFrame, roles: DataFrame, *,
                       actor_id: int | None = None) -> tuple[DataFrame, DataFrame]:
    """B2 + Q6: transfer requests → (double-entry ledger lines, rejects).

    OUT at the source (when there is one) is line 1, IN at the target follows;
    department, receipt, plate and partner are NULL.  mode is ``transfer`` or
    ``in_only``.  Rule order: permission, target, quantity, note, source ≠
    target, product, location lock (target, then source).
    """
    req = requests
    if "product_type" not in req.columns:
        req = req.withColumn("product_type", F.lit(S.DEFAULT_PRODUCT))
    req = _join_actor(req, _actor_table(users, roles, ["cases.internal_transfer"]), actor_id)
    src = F.when(F.coalesce(F.col("from_location_id"), F.lit(0)) != 0, F.col("from_location_id"))
    to = F.col("to_location_id")
    note = trim_to_null("note")
    reason = R.first_reason(
        F.when(~F.coalesce(F.col("cases_internal_transfer"), F.lit(False)), F.lit(S.ERR_NO_PERMISSION)),
        F.when(F.coalesce(to, F.lit(0)) == 0, F.lit(S.ERR_TO_LOCATION)),
        F.when(~_int_ok(F.col("qty"), 1), F.lit(S.ERR_QTY)),
        F.when(note.isNull(), F.lit(S.ERR_NOTE_REQUIRED)),
        F.when(src.isNotNull() & (src == to), F.lit(S.ERR_SAME_LOCATION)),
        R.product_error("product_type"),
        F.when(F.col("_lock").isNotNull() & (to != F.col("_lock")), F.lit(S.ERR_FORBIDDEN)),
        F.when(F.col("_lock").isNotNull() & src.isNotNull() & (src != F.col("_lock")), F.lit(S.ERR_FORBIDDEN)))
    checked = req.withColumn("reason", reason).withColumn("_src", src)
    rejects = checked.where(F.col("reason").isNotNull()).select("request_id", "actor_id", "reason")
    ok = checked.where(F.col("reason").isNull())
    lines = F.filter(F.array(
        F.struct(F.col("_src").alias("location_id"), F.lit("OUT").alias("type"), F.lit(1).alias("line_no")),
        F.struct(to.alias("location_id"), F.lit("IN").alias("type"),
                 F.when(F.col("_src").isNotNull(), F.lit(2)).otherwise(F.lit(1)).alias("line_no"))),
        lambda x: x["location_id"].isNotNull())
    base = ok.select(
        "request_id", F.col("actor_id").alias("user_id"), F.col("qty").alias("quantity"), note.alias("note"),
        R.product_value("product_type").alias("product_type"),
        group_id(F.lit("transfer"), F.col("request_id")).alias("booking_group_id"),
        F.when(F.col("_src").isNotNull(), F.lit("transfer")).otherwise(F.lit("in_only")).alias("mode"),
        lines.alias("_l"))
    out = base.select("*", F.inline("_l")).drop("_l").select(
        "request_id", "location_id", F.lit(None).cast("int").alias("department_id"), "user_id", "type", "quantity",
        "note", F.lit(None).cast("string").alias("receipt_no"), F.lit(None).cast("string").alias("license_plate"),
        F.lit(None).cast("string").alias("entrepreneur"), "booking_group_id", "line_no", "product_type", "mode")
    return out, rejects
