"""Change feed (S5) from table differences.

What the reference announces after each write follows from the rows before and after it: a created, changed
or deleted case, ledger line or notice.  ``changes`` compares two versions of a table by key, so creates,
edits, approvals and deletes need no code of their own, and what is announced is what stands afterwards (a
new receipt's number included).  Each channel's events carry a number that counts up per batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from carrierbook.operators.numbering import number_rows
from carrierbook.streaming.case_feed import (BOOKINGS_UPDATED, CASES_UPDATED, NOTIFICATION_CREATED, NOTIFICATIONS_DELETED,
                                             STOCK_UPDATED)

EVENT = "channel string, event string, location_id int, department_id int, receipt_no string, user_id int, case_id int"


def changes(before: DataFrame, after: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, before, after): the rows that differ, each side as a struct of ``columns`` (null where there is none)."""
    def side(df, name):
        row = F.struct(*columns)
        # NULL equals NULL here: equal rows have equal structs.
        return df.select(*keys, row.alias(name))

    both = side(before, "before").join(side(after, "after"), keys, "full")
    return both.where(~F.col("before").eqNullSafe(F.col("after")))


def _event(channel, event, **fields):
    parts = [channel.alias("channel"), F.lit(event).alias("event")]
    for name, kind in (f.strip().split() for f in EVENT.split(",")[2:]):
        parts.append(fields.get(name, F.lit(None)).cast(kind).alias(name))
    return parts


def _location(c):
    return F.concat(F.lit("loc:"), c.cast("string"))


def case_events(before: DataFrame, after: DataFrame) -> DataFrame:
    """``casesUpdated`` on the location of each case that was created, changed or deleted."""
    columns = [c for c in after.columns if c != "id" and c in before.columns]
    rows = changes(before, after, ["id"], columns)
    at = F.coalesce("after.location_id", "before.location_id")
    return rows.select(*_event(_location(at), CASES_UPDATED, location_id=at, case_id=F.col("id")))


def ledger_events(before: DataFrame, after: DataFrame) -> DataFrame:
    """``stockUpdated`` and ``bookingsUpdated`` once per location, department and receipt with a created, changed or deleted line."""
    rows = changes(before, after, ["id"], ["location_id", "department_id", "receipt_no", "type", "quantity", "note", "entrepreneur",
                                           "license_plate", "product_type"])
    row = F.coalesce("after", "before")
    at = rows.select(row["location_id"].alias("location_id"), row["department_id"].alias("department_id"),
                     row["receipt_no"].alias("receipt_no")).distinct()
    where = _location(F.col("location_id"))
    kinds = F.explode(F.array(F.lit(STOCK_UPDATED), F.lit(BOOKINGS_UPDATED)))
    full = at.select("*", kinds.alias("event"))
    books = F.col("event") == BOOKINGS_UPDATED
    stock = full.select(where.alias("channel"), "event", "location_id", F.when(books, F.col("department_id")).alias("department_id"),
                        F.when(books, F.col("receipt_no")).alias("receipt_no"), F.lit(None).cast("int").alias("user_id"),
                        F.lit(None).cast("int").alias("case_id"))
    return stock.distinct()


def notice_events(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per reader: ``notificationCreated`` for each notice that came, one ``notificationsDeleted`` where some went.

    Both tables are (user_id, case_id, title) rows, the readers' view of the notices.
    """
    keys = ["user_id", "case_id", "title"]
    was, now = before.select(*keys).distinct(), after.select(*keys).distinct()
    came, gone = now.join(was, keys, "left_anti"), was.join(now, keys, "left_anti").select("user_id").distinct()
    to = F.concat(F.lit("user:"), F.col("user_id").cast("string"))
    return (came.select(*_event(to, NOTIFICATION_CREATED, user_id=F.col("user_id"), case_id=F.col("case_id")))
            .unionByName(gone.select(*_event(to, NOTIFICATIONS_DELETED, user_id=F.col("user_id")))))


_ORDER = ["event", "case_id", "department_id", "receipt_no", "user_id", "location_id"]


def numbered(events: DataFrame, batch: int = 0) -> DataFrame:
    """The events of a batch with ``batch`` and ``n``, their place in their channel from 1."""
    return number_rows(events, [F.col(c).asc_nulls_first() for c in _ORDER], group=["channel"], out="n").withColumn("batch", F.lit(batch).cast("long"))


def numbered_by_reader(events: DataFrame, batch: int = 0) -> DataFrame:
    """:func:`numbered` for readers' channels, as a plan: a channel holds what one reader is told in a batch, no more than the notices of
    the reader's audiences, and a filter on the reader goes below the numbering."""
    own = Window.partitionBy("channel", "user_id").orderBy(*[F.col(c).asc_nulls_first() for c in _ORDER])
    return events.withColumns({"n": F.row_number().over(own).cast("long"), "batch": F.lit(batch).cast("long")})
