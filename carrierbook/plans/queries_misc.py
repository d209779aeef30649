"""Registered queries: dimension lists (S1), role lookup (J6), case receipts (D2),
exports (S3, S4), live stock (T1, batch form), change feed (S5) and the
notification feed of replayed actions (T2)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from carrierbook.operators import access, lifecycle, receipts
from carrierbook.plans.catalog import register
from carrierbook.plans.queries_lifecycle import REPLAY_SQL
from carrierbook.sources import export
from carrierbook.sources.fixtures import with_prefix
from carrierbook.streaming import case_feed, live_stock

DAY = dt.date(2024, 2, 1)


@register("list_locations", with_prefix("locations") + "SELECT id, name FROM locations")
def list_locations(t):
    """Locations sorted by name."""
    return export.dim_list(t.locations, ["id", "name"])


@register("list_departments", with_prefix("departments") + "SELECT id, name FROM departments")
def list_departments(t):
    """Departments sorted by name."""
    return export.dim_list(t.departments, ["id", "name"])


@register("list_entrepreneurs", with_prefix("entrepreneurs") + "SELECT id, name, street, postal_code, city FROM entrepreneurs")
def list_entrepreneurs(t):
    """Partners sorted by name."""
    return export.dim_list(t.entrepreneurs, ["id", "name", "street", "postal_code", "city"])


@register("list_users", with_prefix("users") + "SELECT id, username, role, location_id, role_id, is_active, fixed_department_id FROM users")
def list_users(t):
    """Users sorted by username (no password hashes)."""
    return export.dim_list(t.users, ["id", "username", "role", "location_id", "role_id", "is_active", "fixed_department_id"],
                           order="username")


@register("user_roles", with_prefix("users", "roles") + """
SELECT u.id, u.username, u.role, u.location_id, u.role_id, u.is_active, ro.name AS business_role_name
FROM users u LEFT JOIN roles ro ON ro.id=u.role_id""")
def user_roles(t):
    """Users with their business role name."""
    return access.me(t.users, t.roles)


_QIN = "greatest(coalesce(c.qty_in,0)-coalesce(c.non_exchangeable_qty,0),0)"
_BOOKED = "(c.status=4 AND c.receipt_no IS NOT NULL AND c.receipt_no<>'')"
_PREVIEW = ("'ICS' || upper(coalesce(nullif(regexp_extract(l.name,'([A-Za-zÄÖÜ])',1),''),'L')) || "
            "coalesce(nullif(regexp_extract(l.name,'([0-9]+)',1),''), CAST(c.location_id AS VARCHAR)) || '-20240201-000001'")


@register("case_receipts", with_prefix("booking_cases", "users", "locations", "departments", "entrepreneurs") + f"""
SELECT c.id AS case_id, CASE WHEN {_BOOKED} THEN c.receipt_no ELSE {_PREVIEW} END AS receipt_no, NOT {_BOOKED} AS provisional,
 c.created_at, l.name AS location, coalesce(d.name,'(gelöschte Abteilung)') AS department, coalesce(u.username,'(gelöscht)') AS aviso_created_by,
 c.employee_code, c.license_plate, c.entrepreneur, e.street AS entrepreneur_street, e.postal_code AS entrepreneur_postal_code,
 e.city AS entrepreneur_city, c.note, {_QIN} AS qty_in, coalesce(c.qty_out,0) AS qty_out, coalesce(c.non_exchangeable_qty,0) AS non_exchangeable_qty,
 coalesce(c.product_type,'euro') AS product_type,
 concat_ws(',', CASE WHEN {_QIN} > 0 THEN 'IN:' || {_QIN} END, CASE WHEN coalesce(c.qty_out,0) > 0 THEN 'OUT:' || c.qty_out END) AS lines_text
FROM booking_cases c JOIN locations l ON l.id=c.location_id LEFT JOIN departments d ON d.id=c.department_id
LEFT JOIN users u ON u.id=c.created_by LEFT JOIN entrepreneurs e ON e.name=c.entrepreneur""")
def case_receipts(t):
    """D2 + D3 + J5: every case's receipt view (booked number or preview), lines as text."""
    r = receipts.case_receipts(t.booking_cases, t.users, t.locations, t.departments, t.entrepreneurs,
                               receipt_seq_next=1, today=DAY)
    txt = F.array_join(F.transform("lines", lambda x: F.concat(x["type"], F.lit(":"), x["quantity"].cast("string"))), ",")
    return r.withColumn("lines_text", txt).drop("lines")


_EXPORT_SQL = with_prefix("bookings", "users") + """
SELECT b.id, b.created_at, b.receipt_no, b.license_plate, b.entrepreneur, coalesce(u.username,'(gelöscht)') AS username, b.type, b.quantity, b.note
FROM bookings b LEFT JOIN users u ON u.id=b.user_id WHERE b.location_id=3 AND b.department_id=2"""


@register("export_ledger", _EXPORT_SQL)
def export_ledger(t):
    """S3: the ledger of location 3 × department 2 in export field order, ascending id."""
    return export.export_ledger(t.bookings, t.users, t.locations, t.departments, 3, 2)


@register("export_labelled", "SELECT created_at AS \"Datum/Zeit\", receipt_no AS \"Belegnr.\", license_plate AS \"Kennzeichen\", "
          "entrepreneur AS \"Unternehmer\", username AS \"Benutzer\", type AS \"Typ\", quantity AS \"Menge\", note AS \"Notiz\" FROM ("
          + _EXPORT_SQL + ")")
def export_labelled(t):
    """The same rows under the labelled export headers."""
    return export.labelled(export.export_ledger(t.bookings, t.users, t.locations, t.departments, 3, 2))


@register("live_stock", with_prefix("bookings") + """
SELECT location_id, department_id, coalesce(product_type,'euro') AS product_type,
 CAST(coalesce(sum(CASE WHEN type='IN' THEN quantity END),0) AS BIGINT) AS ins, CAST(coalesce(sum(CASE WHEN type='OUT' THEN quantity END),0) AS BIGINT) AS outs,
 CAST(coalesce(sum(CASE WHEN type='IN' THEN quantity END),0) - coalesce(sum(CASE WHEN type='OUT' THEN quantity END),0) AS BIGINT) AS saldo
FROM bookings GROUP BY 1, 2, 3""")
def live_stock_q(t):
    """T1 (batch form of the streaming aggregate): balance per location, department, product."""
    return live_stock.live_stock(t.bookings, dedup_key=None)


@register("change_feed", REPLAY_SQL + """,
acc AS (SELECT o.action_id, o.case_id, o.action, c.location_id, c.department_id, c.receipt_no FROM outc o JOIN booking_cases c ON c.id=o.case_id WHERE o.reason IS NULL)
SELECT action_id, case_id, 'loc:' || location_id AS channel, 'casesUpdated' AS event, location_id, CAST(NULL AS INTEGER) AS department_id, CAST(NULL AS VARCHAR) AS receipt_no FROM acc
UNION ALL SELECT action_id, case_id, 'loc:' || location_id, 'stockUpdated', location_id, NULL, NULL FROM acc WHERE action='approve'
UNION ALL SELECT action_id, case_id, 'loc:' || location_id, 'bookingsUpdated', location_id, department_id, receipt_no FROM acc WHERE action='approve'""")
def change_feed(t):
    """Change events of the replayed action log (per location channel)."""
    out = lifecycle.replay(t.case_actions, t.booking_cases, t.users, t.roles)
    return case_feed.change_events(out, t.booking_cases)


@register("replay_department_notices", REPLAY_SQL.replace("booking_cases AS (", "departments AS (select distinct cast(substr(o_orderpriority,1,1) as int) id, substr(o_orderpriority,3) name from orders union all select 6 id, 'UNUSED' name),\nbooking_cases AS (", 1) + """,
sub AS (SELECT c.id, c.department_id, o.actor_id AS submitter FROM outc o JOIN booking_cases c ON c.id=o.case_id WHERE o.reason IS NULL AND o.action='submit')
SELECT u.id AS user_id, s.id AS case_id, 'Aviso Abteilung (Status 3)' AS title,
 'Aviso #' || s.id || ' ist in Prüfung (' || coalesce(d.name, 'Abteilung ' || s.department_id) || ').' AS message
FROM sub s JOIN users u ON u.is_active AND u.fixed_department_id=s.department_id AND u.id IS DISTINCT FROM s.submitter
LEFT JOIN departments d ON d.id=s.department_id WHERE coalesce(s.department_id,0)<>0""")
def replay_department_notices(t):
    """Department notices created by the submits of the replayed log."""
    out = lifecycle.replay(t.case_actions, t.booking_cases, t.users, t.roles)
    return case_feed.notification_feed(out, t.booking_cases, t.users, t.departments, t.user_notifications)[0]


@register("login_bursts", "WITH RECURSIVE " + with_prefix("login_attempts")[5:].rstrip() + """,
e AS (SELECT *, row_number() OVER (PARTITION BY ip ORDER BY ts, attempt_id) AS rn FROM login_attempts),
w AS (SELECT ip, rn, attempt_id, ts, ok, 1 AS cnt, ts + INTERVAL 1 DAY AS exp, ok AS cleared FROM e WHERE rn=1
 UNION ALL
 SELECT e.ip, e.rn, e.attempt_id, e.ts, e.ok,
  CASE WHEN w.cleared OR w.exp <= e.ts THEN 1 ELSE w.cnt + 1 END,
  CASE WHEN w.cleared OR w.exp <= e.ts THEN e.ts + INTERVAL 1 DAY ELSE w.exp END,
  e.ok AND (CASE WHEN w.cleared OR w.exp <= e.ts THEN 1 ELSE w.cnt + 1 END) <= 5
 FROM w JOIN e ON e.ip=w.ip AND e.rn=w.rn+1)
SELECT attempt_id, ip, ts, ok, CAST(cnt AS BIGINT) AS attempt_count, cnt > 5 AS blocked FROM w""")
def login_bursts(t):
    """T4: every login attempt's count in its window and whether it is blocked (window 1 day, limit 5)."""
    from carrierbook.operators.burst import burst_flags
    return burst_flags(t.login_attempts, window=dt.timedelta(days=1), limit=5)


@register("transfer_feed", with_prefix("transfer_requests") + """,
ok AS (SELECT * FROM transfer_requests WHERE coalesce(to_location_id,0)<>0 AND qty >= 1 AND nullif(trim(note),'') IS NOT NULL
  AND NOT (coalesce(from_location_id,0)<>0 AND from_location_id=to_location_id)),
loc AS (SELECT request_id, to_location_id AS location_id FROM ok UNION SELECT request_id, from_location_id FROM ok WHERE coalesce(from_location_id,0)<>0)
SELECT request_id, 'loc:' || location_id AS channel, e.event, location_id FROM loc, (VALUES ('stockUpdated'), ('bookingsUpdated')) e(event)""")
def transfer_feed(t):
    """S5 for transfers: stockUpdated and bookingsUpdated on every location a transfer touches (admin as actor)."""
    from carrierbook.operators import posting
    lines, _ = posting.internal_transfers(t.transfer_requests, t.users, t.roles, actor_id=1)
    return case_feed.transfer_events(lines)


@register("notification_events", with_prefix("booking_cases", "users", "locations", "user_notifications") + """,
created AS (SELECT u.id AS user_id, c.id AS case_id FROM booking_cases c
  JOIN users u ON u.is_active AND u.location_id=c.location_id AND (c.created_by IS NULL OR u.id<>c.created_by) WHERE c.status=1),
d AS (SELECT n.* FROM user_notifications n JOIN booking_cases c ON n.case_id=c.id
  WHERE (n.title='Aviso Standort (Status 1)' AND c.status>=3) OR (n.title='Aviso Abteilung (Status 3)' AND c.status>=4)
  UNION ALL SELECT n.* FROM user_notifications n WHERE NOT EXISTS (SELECT 1 FROM booking_cases c WHERE c.id=n.case_id))
SELECT 'user:' || user_id AS channel, 'notificationCreated' AS event, user_id, case_id, CAST(NULL AS BIGINT) AS n_ids,
 CAST(NULL AS VARCHAR) AS ids FROM created
UNION ALL
SELECT 'user:' || user_id, 'notificationsDeleted', user_id, CAST(NULL AS INTEGER), CAST(count(*) AS BIGINT),
 string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) FROM d GROUP BY user_id""")
def notification_events(t):
    """S5 for notices: created by the location fan-out of announced cases, deleted by pruning (per user)."""
    from carrierbook.operators import notify
    created = notify.location_fanout(t.booking_cases.where(F.col("status") == 1), t.users, t.locations)
    _, deleted = notify.prune(t.user_notifications, t.booking_cases)
    ev = case_feed.notification_events(created, deleted)
    return ev.select("channel", "event", "user_id", "case_id",
                     F.size("notification_ids").cast("bigint").alias("n_ids"),
                     F.array_join(F.transform("notification_ids", lambda x: x.cast("string")), ",").alias("ids")) \
        .withColumn("n_ids", F.when(F.col("event") == "notificationsDeleted", F.col("n_ids"))) \
        .withColumn("ids", F.when(F.col("event") == "notificationsDeleted", F.col("ids")))
