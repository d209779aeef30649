"""Receipt roll-up (A2), paging (L2), receipt documents (D1, D2, A6) and the
receipt-number format (D3)."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carrierbook.functions.receipt_no import receipt_number
from carrierbook.functions.rules import product_or_default
from carrierbook.operators.balance import signed_sums
from carrierbook.operators.filters import (all_of, contains_if_given, date_from, date_to, location_scope)
from carrierbook.operators.skew import join_dimension, join_salted
from carrierbook.sources import schema as S


def user_name(users: DataFrame, id_col: str, name_col: str) -> DataFrame:
    """(id -> username) projection of the users dimension under new names."""
    return users.select(F.col("id").alias(id_col), F.col("username").alias(name_col))


def partner_address(entrepreneurs: DataFrame) -> DataFrame:
    """The partners by name with their address under the receipts' names."""
    return entrepreneurs.select(F.col("name").alias("entrepreneur"), F.col("street").alias("entrepreneur_street"),
                                F.col("postal_code").alias("entrepreneur_postal_code"), F.col("city").alias("entrepreneur_city"))


def placeholder(c: str, text: str = S.DELETED_USER) -> Column:
    return F.coalesce(F.col(c), F.lit(text))


def case_receipt_side(booking_cases: DataFrame, users: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """Per receipt number: the case fields the roll-up shows (J3) and how many cases carry it.

    ``only`` (a DataFrame with ``receipt_no``) restricts the cases to those
    receipts first, so a selective roll-up does not aggregate every case.
    """
    c = (booking_cases.where(F.col("receipt_no").isNotNull())
         .select("receipt_no", "created_by", "approved_by", "employee_code"))
    if only is not None:
        c = c.join(only.select("receipt_no"), "receipt_no", "left_semi")
    c = (c.join(user_name(users, "created_by", "_uc"), "created_by", "left")
          .join(user_name(users, "approved_by", "_ua"), "approved_by", "left"))
    return c.groupBy("receipt_no").agg(
        F.max(placeholder("_uc")).alias("aviso_created_by"),
        F.max(placeholder("_ua")).alias("aviso_approved_by"),
        F.max("employee_code").alias("employee_code"),
        F.count(F.lit(1)).alias("_n_cases"),
    )


def receipt_rollup(bookings: DataFrame, booking_cases: DataFrame, users: DataFrame, *,
                   department_id: int, location_id: int | None = None, date_from_: str | None = None,
                   date_to_: str | None = None, entrepreneur: str | None = None,
                   license_plate: str | None = None, receipt_no: str | None = None) -> DataFrame:
    """A2: one row per receipt number of a department's ledger.

    The ledger is filtered and aggregated per receipt first; the case side is
    aggregated per receipt separately and joined to that result.  The
    reference joins lines to cases before grouping, so a receipt number held
    by n > 1 cases multiplies its sums by n; ``_n_cases`` reproduces that.
    """
    preds = [F.col("department_id") == F.lit(department_id), location_scope(location_id),
             date_from(date_from_), date_to(date_to_),
             contains_if_given("entrepreneur", entrepreneur), contains_if_given("license_plate", license_plate),
             contains_if_given("receipt_no", receipt_no, coalesce_blank=False)]
    lines = bookings.where(all_of(*preds)).select(
        "id", "created_at", "receipt_no", "license_plate", "entrepreneur", "note", "user_id", "type",
        "quantity", "product_type")
    lines = lines.join(user_name(users, "user_id", "_u"), "user_id", "left")
    per_receipt = lines.groupBy("receipt_no").agg(
        F.min("id").alias("id"), F.min("created_at").alias("created_at"),
        F.max("license_plate").alias("license_plate"), F.max("entrepreneur").alias("entrepreneur"),
        F.max("note").alias("note"), F.max(placeholder("_u")).alias("user_name"),
        F.max(product_or_default("product_type")).alias("product_type"),
        *signed_sums())
    # A roll-up scoped to one location or narrowed by a search keeps few
    # receipts: then only the cases of those receipts are looked at (a semi
    # join, broadcast when the key set is small).  Company-wide roll-ups keep
    # most receipts, where the extra join would cost more than it saves.
    selective = (location_id not in (None, -1)) or any(x and x.strip() for x in (entrepreneur, license_plate, receipt_no))
    side = case_receipt_side(booking_cases, users, only=per_receipt if selective else None)
    out = per_receipt.join(side, "receipt_no", "left")
    mult = F.greatest(F.coalesce(F.col("_n_cases"), F.lit(1)), F.lit(1)).cast("bigint")
    return out.select(
        "id", "created_at", "receipt_no", "license_plate", "entrepreneur", "note", "user_name",
        placeholder("aviso_created_by").alias("aviso_created_by"),
        placeholder("aviso_approved_by").alias("aviso_approved_by"), "employee_code", "product_type",
        (F.coalesce(F.col("_ins"), F.lit(0)) * mult).cast("bigint").alias("qty_in"),
        (F.coalesce(F.col("_outs"), F.lit(0)) * mult).cast("bigint").alias("qty_out"))


def clamp_page(limit, offset) -> tuple[int, int]:
    """L2 parameter rules: limit 1..100 (default 20), offset >= 0 (default 0)."""
    lim = limit if isinstance(limit, int) else 20
    off = offset if isinstance(offset, int) else 0
    return min(max(lim, 1), 100), max(off, 0)


def page(df: DataFrame, order: list[Column], limit=20, offset=0) -> DataFrame:
    """L2: one page plus a ``has_more`` flag, by fetching limit+1 rows.

    ``orderBy().offset().limit()`` plans as a single TakeOrderedAndProject;
    the flag is computed on the at most 101 fetched rows.
    """
    lim, off = clamp_page(limit, offset)
    fetched = df.orderBy(*order).offset(off).limit(lim + 1)
    w = Window.orderBy(*order)
    ranked = fetched.withColumn("_rn", F.row_number().over(w)).withColumn(
        "has_more", F.max("_rn").over(Window.partitionBy(F.lit(1))) > F.lit(lim))
    return ranked.where(F.col("_rn") <= lim).drop("_rn")


def page_after(df: DataFrame, key: str, last_key, limit=20) -> DataFrame:
    """Keyset form of L2 for deep pages: rows with ``key < last_key``, newest first."""
    lim, _ = clamp_page(limit, 0)
    base = df if last_key is None else df.where(F.col(key) < F.lit(last_key))
    return page(base, [F.col(key).desc()], lim, 0)


# Lines are counted in LINE_BUCKETS buckets of receipts; a bucket of more than CROWDED lines may hold a receipt of very many.
LINE_BUCKETS = 1 << 16
CROWDED = 200_000


def receipt_lines(bookings: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """The lines of every receipt with their position on it.

    Order: ``COALESCE(line_no, 999999)``, then id (type and quantity break
    exact ties).  Receipts are dealt by number and their lines ranked there;
    in buckets of receipts with more than ``crowded`` lines the positions come
    from range-partitioned numbering, so a receipt number carried by very many
    lines is still spread over tasks.
    """
    from carrierbook.operators.numbering import number_rows
    order = ["_ord", "id", "type", "quantity"]
    bucket = F.pmod(F.hash("receipt_no"), F.lit(LINE_BUCKETS))
    b = bookings.where(F.col("receipt_no").isNotNull()).select(
        "receipt_no", "id", "line_no", "type", "quantity",
        F.coalesce(F.col("line_no"), F.lit(S.RECEIPT_LINE_NO_DEFAULT)).alias("_ord"))
    full = [r[0] for r in b.groupBy(bucket.alias("_b")).count().where(F.col("count") > crowded).select("_b").collect()]
    few = b.where(~bucket.isin(full)) if full else b
    out = few.withColumn("position", F.row_number().over(Window.partitionBy("receipt_no").orderBy(*order)).cast("bigint"))
    if full:
        out = out.unionByName(number_rows(b.where(bucket.isin(full)), order, group=["receipt_no"], out="position"))
    return out.select("receipt_no", "position", "id", "line_no", "type", "quantity")


def receipt_documents(headers: DataFrame, lines: DataFrame, part_size: int = 1000) -> DataFrame:
    """Nest the numbered lines into their receipt header: one row per (receipt, part).

    ``lines`` holds at most ``part_size`` lines in position order; a receipt
    with more lines continues in the next part (``part`` 0, 1, ...).  Receipts
    from an approval or a transfer have one or two lines, so they are one
    part, but a receipt number shared by very many lines never becomes one
    task's array.
    """
    parted = lines.withColumn("part", ((F.col("position") - 1) / F.lit(part_size)).cast("int"))
    nested = parted.groupBy("receipt_no", "part").agg(F.array_sort(F.collect_list(
        F.struct("position", "type", "quantity"))).alias("_l"))
    return headers.join(nested, "receipt_no", "left").withColumn(
        "lines", F.transform("_l", lambda x: F.struct(x["type"].alias("type"), x["quantity"].alias("quantity")))
    ).drop("_l")


# --- receipt documents ------------------------------------------------------

def document_rows(headers: DataFrame, lines: DataFrame) -> DataFrame:
    """D1 as rows: every line of every receipt in its ``position`` with the receipt's header; the shape is the same at any size.

    Sorted by (receipt_no, position) this is the document; ``documents`` nests it for the receipts that are read.
    """
    return headers.join(lines.select("receipt_no", "position", "type", "quantity"), "receipt_no", "left")


def documents(headers: DataFrame, lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """D1 for the receipts of ``wanted`` (receipt_no): one row each with its ``lines`` in order.

    Only the wanted receipts' lines are gathered; a receipt's own lines are one row, as its reader gets them.
    """
    some = wanted.select("receipt_no").distinct()
    nested = (lines.join(some, "receipt_no", "left_semi").groupBy("receipt_no")
              .agg(F.array_sort(F.collect_list(F.struct("position", "type", "quantity"))).alias("lines")))
    return headers.join(some, "receipt_no", "left_semi").join(nested, "receipt_no", "left")


def ledger_receipts(bookings: DataFrame, booking_cases: DataFrame, users: DataFrame, locations: DataFrame,
                    departments: DataFrame, entrepreneurs: DataFrame) -> DataFrame:
    """Every receipt document header at once (one row per non-NULL receipt number).

    Header fields come from the receipt's first line in the order
    ``COALESCE(line_no, 999999), id`` (exact ties broken by the line's other
    columns), picked by ``min`` over a struct — a partial aggregate.  Lines
    are aggregated per receipt *before* the dimension joins (J3, J5), so the
    joins see one row per receipt; lines at unknown locations are dropped
    first, as the reference's inner join does.  The ordered line list is
    ``receipt_lines`` (nest it with ``receipt_documents``).  As in A2, n > 1
    cases on one receipt multiply the reference's line rows (``mult``).
    """
    known_loc = locations.select(F.col("id").alias("location_id"))
    b = bookings.where(F.col("receipt_no").isNotNull()).join(known_loc, "location_id", "left_semi")
    ord_ = F.coalesce(F.col("line_no"), F.lit(S.RECEIPT_LINE_NO_DEFAULT))
    first = F.struct(ord_.alias("o"), F.col("id").alias("i"), "created_at", "location_id", "department_id",
                     "user_id", "license_plate", "entrepreneur", "note",
                     product_or_default("product_type").alias("product_type"))
    per = b.groupBy("receipt_no").agg(F.min(first).alias("f"), F.count(F.lit(1)).alias("_n_lines"), *signed_sums())
    per = per.select("receipt_no", "f.*", "_n_lines", "_ins", "_outs")
    cases = booking_cases.where(F.col("receipt_no").isNotNull()).groupBy("receipt_no").agg(
        F.min(F.struct("created_by", "employee_code", "non_exchangeable_qty")).alias("c"),
        F.count(F.lit(1)).alias("_n_cases"))
    # Both sides still lie by receipt number here; the lookups by other keys follow.
    out = per.join(cases, "receipt_no", "left").withColumn("_cb", F.col("c.created_by"))
    out = (out.join(user_name(users, "user_id", "_u"), "user_id", "left")
              .join(locations.select(F.col("id").alias("location_id"), F.col("name").alias("location")), "location_id", "left"))
    out = join_dimension(out, departments.select(F.col("id").alias("department_id"), F.col("name").alias("_dname")), "department_id",
                         ["receipt_no"])
    out = out.join(partner_address(entrepreneurs), "entrepreneur", "left")
    # Receipts without a case have no creator: they are dealt to many parts.
    out = join_salted(out, user_name(users, "_cb", "_uc"), "_cb", [None], ["receipt_no"])
    mult = F.greatest(F.coalesce(F.col("_n_cases"), F.lit(1)), F.lit(1)).cast("bigint")
    has_case = F.col("_n_cases").isNotNull()
    return out.select(
        "receipt_no", "created_at", "location", "location_id",
        F.coalesce(F.col("_dname"), F.lit(S.DELETED_DEPARTMENT)).alias("department"),
        placeholder("_u").alias("username"), "license_plate", "entrepreneur", "entrepreneur_street",
        "entrepreneur_postal_code", "entrepreneur_city",
        placeholder("_uc").alias("aviso_created_by"),
        F.when(has_case, F.col("c.employee_code")).alias("employee_code"), "note",
        (F.coalesce(F.col("_ins"), F.lit(0)) * mult).cast("bigint").alias("qty_in"),
        (F.coalesce(F.col("_outs"), F.lit(0)) * mult).cast("bigint").alias("qty_out"),
        F.coalesce(F.col("c.non_exchangeable_qty"), F.lit(0)).alias("non_exchangeable_qty"),
        "product_type", (F.col("_n_lines") * mult).alias("line_count"))


def case_receipts(booking_cases: DataFrame, users: DataFrame, locations: DataFrame, departments: DataFrame,
                  entrepreneurs: DataFrame, receipt_seq_next: int = 1, today: _dt.date | None = None) -> DataFrame:
    """The receipt view of every case, provisional unless booked.

    Booked = status 4 and a receipt number; otherwise the number shown is the
    preview of the next number (D3 with ``receipt_seq_next``).  The shown
    in-quantity is ``max(qty_in - non_exchangeable_qty, 0)``; the line list
    keeps IN then OUT, each only when positive.
    """
    today = today or _dt.date.today()
    c = booking_cases.select(
        "id", "created_at", "license_plate", "entrepreneur", "note", "qty_in", "qty_out", "non_exchangeable_qty",
        "employee_code", "product_type", "status", "receipt_no", "location_id", "department_id", "created_by")
    c = c.join(locations.select(F.col("id").alias("location_id"), F.col("name").alias("location")), "location_id", "inner")
    for keyed, key in ((departments.select(F.col("id").alias("department_id"), F.col("name").alias("_dname")), "department_id"),
                       (user_name(users, "created_by", "_uc"), "created_by"), (partner_address(entrepreneurs), "entrepreneur")):
        c = join_dimension(c, keyed, key, ["id", "created_at"], seen_in=booking_cases)
    qin = F.coalesce(F.col("qty_in"), F.lit(0))
    qout = F.coalesce(F.col("qty_out"), F.lit(0))
    nonx = F.coalesce(F.col("non_exchangeable_qty"), F.lit(0))
    shown_in = F.greatest(qin - nonx, F.lit(0))
    booked = (F.col("status") == S.STATUS_BOOKED) & F.col("receipt_no").isNotNull() & (F.col("receipt_no") != "")
    preview = receipt_number(F.col("location"), F.col("location_id"), F.lit(today), F.lit(receipt_seq_next).cast("bigint"))
    lines = F.filter(F.array(F.struct(F.lit("IN").alias("type"), shown_in.alias("quantity")),
                             F.struct(F.lit("OUT").alias("type"), qout.alias("quantity"))),
                     lambda x: x["quantity"] > 0)
    return c.select(
        F.col("id").alias("case_id"),
        F.when(booked, F.col("receipt_no")).otherwise(preview).alias("receipt_no"),
        (~booked).alias("provisional"), "created_at", "location",
        F.coalesce(F.col("_dname"), F.lit(S.DELETED_DEPARTMENT)).alias("department"),
        placeholder("_uc").alias("aviso_created_by"), "employee_code", "license_plate", "entrepreneur",
        "entrepreneur_street", "entrepreneur_postal_code", "entrepreneur_city", "note",
        shown_in.alias("qty_in"), qout.alias("qty_out"), nonx.alias("non_exchangeable_qty"),
        product_or_default("product_type").alias("product_type"), lines.alias("lines"))
