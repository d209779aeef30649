"""Registered queries: notification fan-out, pruning, deletes, read marks, inbox."""

from __future__ import annotations

from pyspark.sql import functions as F

from carrierbook.operators import notify
from carrierbook.plans.catalog import register
from carrierbook.sources.fixtures import with_prefix


@register("location_fanout", with_prefix("booking_cases", "users", "locations") + """
SELECT u.id AS user_id, c.id AS case_id, 'Aviso Standort (Status 1)' AS title,
 'Neues Aviso #' || c.id || ' am ' || coalesce(l.name, 'Standort ' || c.location_id) || '.' AS message
FROM booking_cases c JOIN users u ON u.is_active AND u.location_id=c.location_id AND (c.created_by IS NULL OR u.id<>c.created_by)
LEFT JOIN locations l ON l.id=c.location_id WHERE c.status=1""")
def location_fanout(t):
    """M1: notices for all announced (status 1) cases."""
    return notify.location_fanout(t.booking_cases.where(F.col("status") == 1), t.users, t.locations)


@register("department_fanout", with_prefix("booking_cases", "users", "departments") + """
SELECT u.id AS user_id, c.id AS case_id, 'Aviso Abteilung (Status 3)' AS title,
 'Aviso #' || c.id || ' ist in Prüfung (' || coalesce(d.name, 'Abteilung ' || c.department_id) || ').' AS message
FROM booking_cases c JOIN users u ON u.is_active AND u.fixed_department_id=c.department_id
 AND u.id IS DISTINCT FROM coalesce(nullif(c.submitted_by,0), c.created_by)
LEFT JOIN departments d ON d.id=c.department_id WHERE c.status=3 AND coalesce(c.department_id,0)<>0""")
def department_fanout(t):
    """M2: notices for all cases in review (status 3), excluding the submitter."""
    return notify.department_fanout(t.booking_cases.where(F.col("status") == 3), t.users, t.departments)


_PRUNE = with_prefix("booking_cases", "user_notifications") + """,
d AS (SELECT n.* FROM user_notifications n JOIN booking_cases c ON n.case_id=c.id
  WHERE (n.title='Aviso Standort (Status 1)' AND c.status>=3) OR (n.title='Aviso Abteilung (Status 3)' AND c.status>=4)
  UNION ALL SELECT n.* FROM user_notifications n WHERE NOT EXISTS (SELECT 1 FROM booking_cases c WHERE c.id=n.case_id)),
k AS (SELECT * FROM user_notifications n WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.id=n.id))
"""


@register("notification_prune", _PRUNE + "SELECT * FROM d")
def notification_prune(t):
    """M3: notices deleted by the status rules and as orphans (all users at once)."""
    return notify.prune(t.user_notifications, t.booking_cases)[1]


@register("notification_prune_kept", _PRUNE + "SELECT * FROM k")
def notification_prune_kept(t):
    """M3: notices that survive pruning."""
    return notify.prune(t.user_notifications, t.booking_cases)[0]


@register("notifications_newest", _PRUNE + """
SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) <= 50""")
def notifications_newest(t):
    """L3: after pruning, the 50 newest notices of every user."""
    return notify.inbox(t.user_notifications, t.booking_cases)[0]


@register("notifications_unread", _PRUNE + """, top AS (
SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) <= 50)
SELECT user_id, count(*) AS items, count(*) FILTER (WHERE NOT is_read) AS unread FROM top GROUP BY user_id""")
def notifications_unread(t):
    """A5: per user, unread notices among the newest 50 after pruning."""
    return notify.inbox(t.user_notifications, t.booking_cases)[1]


@register("notifications_deleted_by_case", with_prefix("booking_cases", "user_notifications") + """,
d AS (SELECT n.* FROM user_notifications n WHERE n.case_id IN (SELECT id FROM booking_cases WHERE status=0))
SELECT user_id, 0 AS part, CAST(count(*) AS BIGINT) AS n_ids, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids FROM d GROUP BY user_id""")
def notifications_deleted_by_case(t):
    """M4 + A7: notices of cancelled cases deleted, ids listed per user (lists of at most 10,000 ids)."""
    targets = t.booking_cases.where(F.col("status") == 0).select(F.col("id").alias("case_id"))
    _, deleted = notify.delete_for_cases(t.user_notifications, targets)
    g = notify.ids_by_user(deleted)
    return g.select("user_id", "part", F.size("notification_ids").cast("bigint").alias("n_ids"),
                    F.array_join(F.transform("notification_ids", lambda x: x.cast("string")), ",").alias("ids"))


@register("notifications_deleted_by_title", with_prefix("booking_cases", "user_notifications") + """
SELECT n.* FROM user_notifications n JOIN (SELECT id FROM booking_cases WHERE status=4) c ON n.case_id=c.id
WHERE n.title='Aviso Abteilung (Status 3)'""")
def notifications_deleted_by_title(t):
    """M4 with titles: department notices of booked cases (the approve step's delete)."""
    targets = t.booking_cases.where(F.col("status") == 4).select(
        F.col("id").alias("case_id"), F.lit("Aviso Abteilung (Status 3)").alias("title"))
    return notify.delete_for_cases(t.user_notifications, targets)[1]


@register("notifications_mark_read", with_prefix("user_notifications", "read_marks") + """,
m AS (SELECT notification_id, user_id, max(read_at) AS read_at FROM read_marks GROUP BY 1, 2)
SELECT n.id, n.user_id, n.case_id, n.title, n.created_at, (n.is_read OR m.notification_id IS NOT NULL) AS is_read, m.read_at
FROM user_notifications n LEFT JOIN m ON m.notification_id=n.id AND m.user_id=n.user_id""")
def notifications_mark_read(t):
    """M5: read marks applied, owner only."""
    return notify.mark_read(t.user_notifications, t.read_marks)
