"""Registered queries: live cases (T3) with notices (T2), receipts and lines (B1, B3), change log (S5), appended ledger
lines (B1, B2), notices by audience (M1, M2, J7, A5) and receipt documents (D1)."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from carrierbook.operators import audience, balance, posting, receipts
from carrierbook.operators.numbering import number_rows
from carrierbook.plans import queries_lists  # noqa: F401  (its oracles are used below)
from carrierbook.plans.catalog import ORACLE, register
from carrierbook.plans.queries_lifecycle import _CASE_ROWS, _log_sql
from carrierbook.plans.queries_posting import _NUMBERED, _QIN, _gid, _transfer_sql
from carrierbook.session import scratch_path
from carrierbook.sources import schema as S
from carrierbook.sources.fixtures import VIEW_SQL, with_prefix
from carrierbook.streaming.exact_stock import ExactStock
from carrierbook.streaming.live_cases import LiveCases

DAY = dt.date(2024, 2, 1)
NOON = "2024-02-01 12:00:00"


def _played(t, deliveries, notices=None):
    """The live cases after the log came in the given deliveries (predicates on the log)."""
    spark = t.case_log.sparkSession
    schema = t.booking_cases.withColumn("approved_at", F.lit(None).cast("timestamp_ntz"))
    live = LiveCases(spark, scratch_path(spark, f"live-cases-{uuid.uuid4().hex}"), t.users, t.roles, t.locations, t.departments,
                     schema, notices=notices, buckets=16, receipt_start=901, line_start=2_000_000_001)
    for k, rule in enumerate(deliveries):
        live(t.case_log.where(rule), k)
    return live


_LATE = ["action_id % 3 <> 1", "action_id % 3 = 1"]
_IN_ORDER = ["ts < timestamp_ntz'2024-01-16 00:00:00'", "ts >= timestamp_ntz'2024-01-16 00:00:00'"]
_COLUMNS = [f.name for f in S.BOOKING_CASES.fields if f.name != "receipt_no"]


@register("live_cases", _log_sql() + "SELECT " + ", ".join(_COLUMNS) + " FROM (" + _CASE_ROWS + ")")
def live_cases(t):
    """The whole log in two deliveries, a third of the actions late; the case table equals the replay in order."""
    return _played(t, _LATE).cases().select(*_COLUMNS)


_RNO_DAY = ("'ICS' || upper(coalesce(nullif(regexp_extract(l.name,'([A-Za-zÄÖÜ])',1),''),'L')) || "
            "coalesce(nullif(regexp_extract(l.name,'([0-9]+)',1),''), CAST(x.location_id AS VARCHAR)) || '-' || strftime(x.done_at, '%Y%m%d') || '-' || "
            "lpad(CAST(x.seq AS VARCHAR), CAST(greatest(6, length(CAST(x.seq AS VARCHAR))) AS INTEGER), '0')")
_BOOKED = f""",
x AS (SELECT c.id, c.location_id, coalesce(u.department_id, c.department_id) AS department_id, coalesce(u.note, c.note) AS note,
  coalesce(u.license_plate, c.license_plate) AS license_plate, coalesce(u.entrepreneur, c.entrepreneur) AS entrepreneur,
  coalesce(u.qty_in, c.qty_in, 0) AS qi, coalesce(u.qty_out, c.qty_out, 0) AS qo, coalesce(u.non_exchangeable_qty, c.non_exchangeable_qty, 0) AS nx,
  coalesce(u.product_type, c.product_type, 'euro') AS product_type, o.actor_id, o.ts AS done_at, row_number() OVER (ORDER BY o.ts, o.action_id) + 900 AS seq
  FROM ok o JOIN booking_cases c ON c.id=o.case_id JOIN upd u ON u.case_id=c.id WHERE o.action='approve'),
n AS (SELECT x.*, greatest(qi - nx, 0) AS booked, {_RNO_DAY} AS rno FROM x LEFT JOIN locations l ON l.id=x.location_id),
posted AS (SELECT id AS case_id, location_id, department_id, actor_id AS user_id, 'IN' AS type, booked AS quantity, note, rno AS receipt_no,
 license_plate, entrepreneur, 1 AS line_no, product_type, done_at, seq FROM n WHERE booked > 0
 UNION ALL SELECT id, location_id, department_id, actor_id, 'OUT', qo, note, rno, license_plate, entrepreneur,
 CASE WHEN booked > 0 THEN 2 ELSE 1 END, product_type, done_at, seq FROM n WHERE qo > 0)
"""


@register("live_lines", _log_sql(with_locations=True) + _BOOKED + f"""
SELECT CAST(2000000001 + 2 * (seq - 901) + line_no - 1 AS BIGINT) AS id, case_id, location_id, department_id, user_id, type, quantity, note, receipt_no,
 license_plate, entrepreneur, line_no, product_type, done_at AS created_at, {_gid("'case|' || case_id || '|' || receipt_no")} AS booking_group_id FROM posted""")
def live_lines(t):
    """T3 + B3 + B1: the log in order in two deliveries; ledger lines with ids, group ids, times and receipt numbers."""
    return _played(t, _IN_ORDER).lines()


_NOTICES_SQL = _log_sql().rstrip() + """,
un AS (SELECT cast(event_id as int) id, cast(user_id+1 as int) user_id, case when event_id%23=0 then null else cast(event_id*7%20000+1 as int) end case_id,
  case when event_id%2=0 then 'Aviso Standort (Status 1)' else 'Aviso Abteilung (Status 3)' end title from events where event_type in ('view','click')),
given AS (SELECT DISTINCT n.case_id, n.title, n.user_id FROM un n JOIN users u ON u.id=n.user_id AND u.is_active
  WHERE NOT EXISTS (SELECT 1 FROM ok o WHERE o.case_id=n.case_id AND (o.action='cancel' OR (o.action='submit' AND n.title='Aviso Standort (Status 1)')
    OR (o.action='approve' AND n.title='Aviso Abteilung (Status 3)')))),
sent AS (SELECT o.case_id, o.actor_id, coalesce(u.department_id, c.department_id) AS dep FROM ok o JOIN booking_cases c ON c.id=o.case_id
  JOIN upd u ON u.case_id=o.case_id WHERE o.action='submit' AND coalesce(u.status, c.status)=3),
made AS (SELECT s.case_id, 'Aviso Abteilung (Status 3)' AS title, u.id AS user_id FROM sent s JOIN users u ON u.is_active AND u.fixed_department_id=s.dep
  AND u.id IS DISTINCT FROM s.actor_id WHERE coalesce(s.dep,0)<>0)
"""


@register("live_notices", _NOTICES_SQL + "SELECT user_id, case_id, title FROM given UNION SELECT user_id, case_id, title FROM made")
def live_notices(t):
    """T2 as a table: after the log in two deliveries, a third of it late, the live notices of every reader."""
    given = t.user_notifications.select("case_id", "title", F.lit(audience.USER).alias("audience"), F.col("user_id").alias("audience_id"),
                                        F.lit(None).cast("int").alias("except_user"), F.lit(None).cast("string").alias("message"), "created_at")
    live = _played(t, _LATE, given)
    return audience.for_readers(live.notices(), audience.members(t.users), once=True)


_STATE = ("location_id, department_id, created_by, status, license_plate, entrepreneur, note, qty_in, qty_out, non_exchangeable_qty, "
          "product_type, employee_code, created_at, claimed_by, submitted_by, approved_by")


@register("case_change_log", _log_sql(with_locations=True) + _BOOKED.rstrip() + f""",
now AS ({_CASE_ROWS}),
diff AS (SELECT id, {_STATE} FROM now EXCEPT SELECT id, {_STATE} FROM booking_cases),
ev AS (SELECT 'loc:' || location_id AS channel, 'casesUpdated' AS event, location_id, CAST(NULL AS INTEGER) AS department_id, CAST(NULL AS VARCHAR) AS receipt_no,
  CAST(NULL AS INTEGER) AS user_id, id AS case_id FROM diff
 UNION ALL SELECT DISTINCT 'loc:' || location_id, 'stockUpdated', location_id, CAST(NULL AS INTEGER), NULL, NULL, NULL FROM posted
 UNION ALL SELECT DISTINCT 'loc:' || location_id, 'bookingsUpdated', location_id, department_id, receipt_no, NULL, NULL FROM posted)
SELECT *, row_number() OVER (PARTITION BY channel ORDER BY event, case_id NULLS FIRST, department_id NULLS FIRST, receipt_no NULLS FIRST) AS n,
 CAST(0 AS BIGINT) AS batch FROM ev""")
def case_change_log(t):
    """S5 from table differences: what the whole log changed, numbered per channel, receipts as they stand after it."""
    live = _played(t, ["true"])
    return live.events(0).where("user_id is null")


# --- lines that can be appended -------------------------------------------------------------------

_LEDGER_COLUMNS = "location_id, department_id, user_id, type, quantity, note, receipt_no, license_plate, entrepreneur, line_no, product_type, created_at"
_APPEND = _transfer_sql(1).replace("WITH ", "WITH " + _NUMBERED[5:].rstrip() + ",\n", 1) + f""",
own AS (SELECT request_id, row_number() OVER (ORDER BY request_id) AS k FROM chk WHERE reason IS NULL),
lines AS (
 SELECT CAST(3000000001 + 2*(seq-1) AS BIGINT) AS id, location_id, department_id, 1 AS user_id, 'IN' AS type, {_QIN} AS quantity, note, rno AS receipt_no,
  license_plate, entrepreneur, 1 AS line_no, coalesce(product_type,'euro') AS product_type FROM n WHERE {_QIN} > 0
 UNION ALL SELECT CAST(3000000001 + 2*(seq-1) + CASE WHEN {_QIN} > 0 THEN 1 ELSE 0 END AS BIGINT), location_id, department_id, 1, 'OUT', coalesce(qty_out,0), note, rno,
  license_plate, entrepreneur, CASE WHEN {_QIN} > 0 THEN 2 ELSE 1 END, coalesce(product_type,'euro') FROM n WHERE coalesce(qty_out,0) > 0
 UNION ALL SELECT CAST(4000000001 + 2*(k-1) AS BIGINT), from_location_id, NULL, 1, 'OUT', qty, trim(note), NULL, NULL, NULL, 1, 'euro'
  FROM chk JOIN own USING (request_id) WHERE coalesce(from_location_id,0)<>0
 UNION ALL SELECT CAST(4000000001 + 2*(k-1) + CASE WHEN coalesce(from_location_id,0)<>0 THEN 1 ELSE 0 END AS BIGINT), to_location_id, NULL, 1, 'IN', qty, trim(note),
  NULL, NULL, NULL, CASE WHEN coalesce(from_location_id,0)<>0 THEN 2 ELSE 1 END, 'euro' FROM chk JOIN own USING (request_id))
"""


def _appended(t):
    """Ledger rows of all cases in review (approved by user 1) and of the admin's transfers."""
    at = F.lit(NOON).cast("timestamp_ntz")
    cases = t.booking_cases.where(F.col("status") == 3).withColumn("approved_by", F.lit(1))
    numbered = posting.assign_receipt_numbers(cases, t.locations, order=["id"], start=1, day=DAY)
    posted = posting.ledger_rows(posting.post_cases(numbered), numbered.withColumnRenamed("id", "case_id"), "case_id", "receipt_seq",
                                 first_id=3_000_000_001, created_at=at).drop("case_id")
    lines, _ = posting.internal_transfers(t.transfer_requests, t.users, t.roles, actor_id=1)
    requests = number_rows(lines.where("line_no = 1").select("request_id"), ["request_id"], out="_k")
    moved = posting.ledger_rows(lines, requests, "request_id", "_k", first_id=4_000_000_001, created_at=at).drop("request_id")
    return posted.unionByName(moved)


@register("ledger_append", _APPEND + f"SELECT *, TIMESTAMP '{NOON}' AS created_at FROM lines")
def ledger_append(t):
    """B1 + B2: approvals and transfers as ledger rows with id and time, in the ledger's own columns."""
    return _appended(t).drop("booking_group_id")


@register("ledger_append_stock", _APPEND.rstrip() + ",\nbookings AS (" + VIEW_SQL["bookings"] + f"""),
whole AS (SELECT {_LEDGER_COLUMNS} FROM bookings UNION ALL SELECT {_LEDGER_COLUMNS.replace('created_at', f"TIMESTAMP '{NOON}'")} FROM lines)
SELECT l.id AS location_id, l.name AS location, CAST(coalesce(sum(quantity) FILTER (type='IN'), 0) AS BIGINT) AS ins,
 CAST(coalesce(sum(quantity) FILTER (type='OUT'), 0) AS BIGINT) AS outs,
 CAST(coalesce(sum(quantity) FILTER (type='IN'), 0) - coalesce(sum(quantity) FILTER (type='OUT'), 0) AS BIGINT) AS saldo
FROM locations l LEFT JOIN whole b ON b.location_id=l.id AND coalesce(b.product_type,'euro')='euro' GROUP BY l.id, l.name""")
def ledger_append_stock(t):
    """B1 + B2 + A1c: stock per location (euro) over the ledger with the new rows appended to it."""
    whole = t.bookings.unionByName(_appended(t).drop("booking_group_id"))
    return balance.stock(whole, mode="location_total", product="euro", locations=t.locations)


# --- notices by audience --------------------------------------------------------------------------

@register("location_notices", with_prefix("booking_cases", "locations") + """
SELECT c.id AS case_id, 'Aviso Standort (Status 1)' AS title, 'location' AS audience, c.location_id AS audience_id, c.created_by AS except_user,
 'Neues Aviso #' || c.id || ' am ' || coalesce(l.name, 'Standort ' || c.location_id) || '.' AS message
FROM booking_cases c LEFT JOIN locations l ON l.id=c.location_id WHERE c.status=1""")
def location_notices(t):
    """M1 by audience: one row per announced case."""
    return audience.location_notices(t.booking_cases.where("status = 1"), t.locations)


@register("department_notices", with_prefix("booking_cases", "departments") + """
SELECT c.id AS case_id, 'Aviso Abteilung (Status 3)' AS title, 'department' AS audience, c.department_id AS audience_id,
 coalesce(nullif(c.submitted_by,0), c.created_by) AS except_user,
 'Aviso #' || c.id || ' ist in Prüfung (' || coalesce(d.name, 'Abteilung ' || c.department_id) || ').' AS message
FROM booking_cases c LEFT JOIN departments d ON d.id=c.department_id WHERE c.status=3 AND coalesce(c.department_id,0)<>0""")
def department_notices(t):
    """M2 by audience: one row per case in review."""
    return audience.department_notices(t.booking_cases.where("status = 3"), t.departments)


_EACH = with_prefix("booking_cases", "users") + """,
each AS (SELECT u.id AS user_id, c.id AS case_id, 'Aviso Standort (Status 1)' AS title FROM booking_cases c JOIN users u ON u.is_active
   AND u.location_id=c.location_id AND u.id IS DISTINCT FROM c.created_by WHERE c.status=1
 UNION ALL SELECT u.id, c.id, 'Aviso Abteilung (Status 3)' FROM booking_cases c JOIN users u ON u.is_active AND u.fixed_department_id=c.department_id
   AND u.id IS DISTINCT FROM coalesce(nullif(c.submitted_by,0), c.created_by) WHERE c.status=3 AND coalesce(c.department_id,0)<>0)
"""


def _notices(t):
    return location_notices(t).unionByName(department_notices(t))


@register("notice_inbox", _EACH + "SELECT user_id, case_id, title FROM each WHERE user_id % 10 = 3 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY case_id DESC, title) <= 50")
def notice_inbox(t):
    """J7 + L3 by audience: the 50 newest notices of some readers, without a row per reader and notice."""
    readers = t.users.where("id % 10 = 3").select(F.col("id").alias("user_id"))
    return audience.newest_for_readers(_notices(t), audience.members(t.users), readers)


@register("notice_counts", _EACH + "SELECT user_id, count(*) AS items, count(*) AS unread FROM each GROUP BY user_id")
def notice_counts(t):
    """A5 by audience: every user's number of notices without a row per user and notice."""
    return audience.unread_counts(_notices(t), audience.members(t.users))


# --- stock that counts every line once -------------------------------------------------------------

@register("live_stock_exact", with_prefix("ledger_feed") + """, once AS (SELECT DISTINCT ON (id) * FROM ledger_feed ORDER BY id, delivery)
SELECT location_id, department_id, coalesce(product_type,'euro') AS product_type, CAST(coalesce(sum(quantity) FILTER (type='IN'),0) AS BIGINT) AS ins,
 CAST(coalesce(sum(quantity) FILTER (type='OUT'),0) AS BIGINT) AS outs,
 CAST(coalesce(sum(quantity) FILTER (type='IN'),0) - coalesce(sum(quantity) FILTER (type='OUT'),0) AS BIGINT) AS saldo FROM once GROUP BY 1, 2, 3""")
def live_stock_exact(t):
    """T1 with exact de-duplication: two deliveries, the second with late lines and copies of earlier ones."""
    stock = ExactStock(t.ledger_feed.sparkSession, scratch_path(t.ledger_feed.sparkSession, f"live-stock-{uuid.uuid4().hex}"))
    for k in (0, 1):
        stock(t.ledger_feed.where(F.col("delivery") == k).drop("delivery"), k)
    return stock.current()


# --- receipt documents ------------------------------------------------------------------------------

_HEADS, _LINES = f"heads_ AS ({ORACLE['ledger_receipts']})", f"lines_ AS ({ORACLE['receipt_lines']})"


@register("receipt_document_rows", f"WITH {_HEADS}, {_LINES} SELECT h.*, l.position, l.type, l.quantity FROM heads_ h LEFT JOIN lines_ l ON l.receipt_no=h.receipt_no")
def receipt_document_rows(t):
    """Every receipt document with its lines in order, as rows."""
    heads = receipts.ledger_receipts(t.bookings, t.booking_cases, t.users, t.locations, t.departments, t.entrepreneurs)
    return receipts.document_rows(heads, receipts.receipt_lines(t.bookings))


@register("receipt_documents_read", f"""WITH {_HEADS}, {_LINES} SELECT h.receipt_no, h.location, h.department, h.line_count,
 string_agg(l.type || ':' || l.quantity, ',' ORDER BY l.position) AS lines_text FROM heads_ h LEFT JOIN lines_ l ON l.receipt_no=h.receipt_no
 WHERE h.receipt_no LIKE '%7' GROUP BY ALL""")
def receipt_documents_read(t):
    """D1 nested for its readers: the documents of some receipts, lines as text."""
    heads = receipts.ledger_receipts(t.bookings, t.booking_cases, t.users, t.locations, t.departments, t.entrepreneurs)
    wanted = t.bookings.where("receipt_no like '%7'").select("receipt_no")
    found = receipts.documents(heads, receipts.receipt_lines(t.bookings), wanted)
    text = F.array_join(F.transform("lines", lambda x: F.concat(x["type"], F.lit(":"), x["quantity"].cast("string"))), ",")
    return found.select("receipt_no", "location", "department", "line_count", text.alias("lines_text"))
