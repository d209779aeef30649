"""Registered queries: action-log replay (B6), batch apply (B5) and approval postings.

The oracle is an independent formulation: a recursive CTE that folds each
case's log one action at a time (the reference's sequential semantics).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from carrierbook.operators import lifecycle, payload_replay, posting
from carrierbook.plans.catalog import register
from carrierbook.plans.queries_access import PERM_CTES
from carrierbook.sources.fixtures import with_prefix

DAY = dt.date(2024, 2, 1)

_PERM_PATH = ("CASE a.action WHEN 'edit' THEN 'cases.edit' WHEN 'claim' THEN 'cases.claim' WHEN 'submit' THEN 'cases.submit' "
              "WHEN 'approve' THEN 'cases.approve' WHEN 'set_translogica' THEN 'bookings.translogica' "
              "WHEN 'cancel' THEN 'cases.cancel' END")

_STEP = """CASE WHEN a.found AND NOT a.forbidden AND a.perm AND ((a.action='claim' AND w.st=1)
   OR (a.action='submit' AND w.st=2 AND NOT a.need_code) OR (a.action='approve' AND w.st=3))
   THEN (CASE a.action WHEN 'claim' THEN 2 WHEN 'submit' THEN 3 ELSE 4 END)
  WHEN a.found AND NOT a.forbidden AND a.perm AND a.action='cancel' AND w.st IN (1,2,3) THEN 0 ELSE w.st END"""

_REASON = """CASE WHEN NOT a.found THEN 'Not found' WHEN a.forbidden THEN 'Forbidden'
 WHEN a.action='edit' THEN CASE WHEN NOT a.perm THEN 'Keine Berechtigung' WHEN w0.st NOT IN (1,2) THEN 'Nur in Status 1/2 editierbar' END
 WHEN a.action='claim' THEN CASE WHEN NOT a.perm THEN 'Keine Berechtigung' WHEN w0.st<>1 THEN 'Nur aus Status 1 möglich' END
 WHEN a.action='submit' THEN CASE WHEN NOT a.perm THEN 'Keine Berechtigung' WHEN w0.st<>2 THEN 'Nur aus Status 2 möglich'
   WHEN a.need_code THEN 'Lagermitarbeiter (2-stellig) ist bei Status 2 Pflicht' END
 WHEN a.action='approve' THEN CASE WHEN NOT a.perm THEN 'Keine Berechtigung' WHEN w0.st<>3 THEN 'Nur aus Status 3 möglich' END
 WHEN a.action='set_translogica' THEN CASE WHEN NOT a.perm THEN 'Keine Berechtigung' WHEN w0.st<>4 THEN 'Nur für gebuchte Vorgänge möglich'
   ELSE 'translogica_transferred must be boolean' END
 WHEN a.action='cancel' THEN CASE WHEN NOT a.perm THEN 'Keine Berechtigung' WHEN w0.st=4 THEN 'Gebuchte Vorgänge können nicht storniert werden'
   WHEN w0.st=0 THEN 'Vorgang ist bereits storniert' END
 ELSE 'unknown action' END"""

REPLAY_SQL = "WITH RECURSIVE " + with_prefix("users", "roles", "booking_cases", "case_actions")[5:].rstrip() + ",\n" + PERM_CTES + f""",
act AS (SELECT a.*, row_number() OVER (PARTITION BY a.case_id ORDER BY a.ts, a.action_id) AS rn,
  c.id IS NOT NULL AS found, c.status AS s0, c.location_id AS loc,
  coalesce(lk.lock IS NOT NULL AND lk.lock <> c.location_id, false) AS forbidden,
  coalesce(p.effective, false) AS perm,
  coalesce(rq.effective, false) AND nullif(c.employee_code,'') IS NULL AS need_code
 FROM case_actions a LEFT JOIN booking_cases c ON c.id=a.case_id
 LEFT JOIN (SELECT id, CASE WHEN role<>'admin' AND location_id IS NOT NULL AND location_id<>0 THEN location_id END AS lock FROM users) lk ON lk.id=a.actor_id
 LEFT JOIN perm p ON p.user_id=a.actor_id AND p.path={_PERM_PATH}
 LEFT JOIN perm rq ON rq.user_id=a.actor_id AND rq.path='cases.require_employee_code'),
walk AS (SELECT case_id, 0 AS rn, max(s0) AS st FROM act GROUP BY case_id
 UNION ALL SELECT w.case_id, a.rn, {_STEP} FROM walk w JOIN act a ON a.case_id=w.case_id AND a.rn=w.rn+1),
outc AS (SELECT a.action_id, a.case_id, a.actor_id, a.action, a.ts, w0.st AS start_status, w1.st AS end_status, {_REASON} AS reason
 FROM act a JOIN walk w0 ON w0.case_id=a.case_id AND w0.rn=a.rn-1 JOIN walk w1 ON w1.case_id=a.case_id AND w1.rn=a.rn)
"""


@register("case_replay", REPLAY_SQL + "SELECT *, reason IS NULL AS accepted FROM outc")
def case_replay(t):
    """Every logged action's outcome when each case's log is replayed in order."""
    return lifecycle.replay(t.case_actions, t.booking_cases, t.users, t.roles)


@register("case_replay_final", REPLAY_SQL + """
SELECT o.case_id, max_by(o.end_status, (o.ts, o.action_id)) AS status,
 coalesce(max(o.actor_id) FILTER (WHERE o.reason IS NULL AND o.action='claim'), max(c.claimed_by)) AS claimed_by,
 max(o.ts) FILTER (WHERE o.reason IS NULL AND o.action='claim') AS claimed_at,
 coalesce(max(o.actor_id) FILTER (WHERE o.reason IS NULL AND o.action='submit'), max(c.submitted_by)) AS submitted_by,
 max(o.ts) FILTER (WHERE o.reason IS NULL AND o.action='submit') AS submitted_at,
 coalesce(max(o.actor_id) FILTER (WHERE o.reason IS NULL AND o.action='approve'), max(c.approved_by)) AS approved_by,
 max(o.ts) FILTER (WHERE o.reason IS NULL AND o.action='approve') AS approved_at,
 count(*) FILTER (WHERE o.reason IS NULL) AS accepted, count(*) FILTER (WHERE o.reason IS NOT NULL) AS rejected
FROM outc o JOIN booking_cases c ON c.id=o.case_id GROUP BY o.case_id""")
def case_replay_final(t):
    """Each case's status, stamps and accepted / rejected counts after its whole log."""
    return lifecycle.final_state(lifecycle.replay(t.case_actions, t.booking_cases, t.users, t.roles), t.booking_cases)


_RNO = ("'ICS' || upper(coalesce(nullif(regexp_extract(l.name,'([A-Za-zÄÖÜ])',1),''),'L')) || "
        "coalesce(nullif(regexp_extract(l.name,'([0-9]+)',1),''), CAST(x.location_id AS VARCHAR)) || '-20240201-' || "
        "lpad(CAST(x.seq AS VARCHAR), CAST(greatest(6, length(CAST(x.seq AS VARCHAR))) AS INTEGER), '0')")


@register("approval_postings", REPLAY_SQL.replace("booking_cases AS (", "locations AS (select cast(n_nationkey+1 as int) id, n_name name from nation),\nbooking_cases AS (", 1) + f""",
x AS (SELECT c.*, o.actor_id AS approver, row_number() OVER (ORDER BY o.ts, o.action_id) + 500 AS seq
  FROM outc o JOIN booking_cases c ON c.id=o.case_id WHERE o.reason IS NULL AND o.action='approve'),
n AS (SELECT x.*, {_RNO} AS rno FROM x LEFT JOIN locations l ON l.id=x.location_id)
SELECT id AS case_id, location_id, department_id, approver AS user_id, 'IN' AS type,
 greatest(coalesce(qty_in,0)-coalesce(non_exchangeable_qty,0),0) AS quantity, note, rno AS receipt_no, license_plate, entrepreneur,
 1 AS line_no, coalesce(product_type,'euro') AS product_type FROM n WHERE greatest(coalesce(qty_in,0)-coalesce(non_exchangeable_qty,0),0) > 0
UNION ALL
SELECT id, location_id, department_id, approver, 'OUT', coalesce(qty_out,0), note, rno, license_plate, entrepreneur,
 CASE WHEN greatest(coalesce(qty_in,0)-coalesce(non_exchangeable_qty,0),0) > 0 THEN 2 ELSE 1 END, coalesce(product_type,'euro')
FROM n WHERE coalesce(qty_out,0) > 0""")
def approval_postings(t):
    """B6 → B3 → B1: accepted approvals of the replay numbered from 501 in approval order and posted."""
    out = lifecycle.replay(t.case_actions, t.booking_cases, t.users, t.roles)
    appr = lifecycle.approvals(out, t.booking_cases)
    numbered = posting.assign_receipt_numbers(appr, t.locations, order=["approved_at", "action_id"], start=501, day=DAY)
    return posting.post_cases(numbered).drop("booking_group_id")


# --- whole logs with payloads -----------------------------------------------------------------------
# The fold carries (status, qty_in, qty_out, employee code) from action to action; the case rows are folded on from it.

_PLATE = "upper(trim(a.license_plate))"
_CODE = "upper(nullif(trim(a.employee_code),''))"
_ROOM = "greatest(coalesce(a.qty_in, w.qi, 0) - coalesce(a.qty_out, w.qo, 0), 0)"


def _log_sql(view: str = "case_log", actions: str = "SELECT * FROM case_log", with_locations: bool = False) -> str:
    """CTEs: ``outc`` (every action with the state it met and its reason) by a sequential fold of each case's log."""
    prefix = with_prefix("users", "roles", "booking_cases", view, *(["locations"] if with_locations else []))[5:].rstrip()
    return "WITH RECURSIVE " + prefix + ",\n" + PERM_CTES + f""",
lg AS ({actions}),
act AS MATERIALIZED (SELECT a.*, row_number() OVER (PARTITION BY a.case_id ORDER BY a.ts, a.action_id) AS rn, c.id IS NOT NULL AS found,
  c.status AS s0, c.qty_in AS i0, c.qty_out AS o0, nullif(c.employee_code,'') AS k0,
  coalesce(lk.lock IS NOT NULL AND lk.lock <> c.location_id, false) AS forbidden, coalesce(p.effective, false) AS perm,
  coalesce(rq.effective, false) AS req, {_CODE} AS code,
  CASE WHEN a.license_plate IS NULL THEN NULL WHEN {_PLATE}='' THEN 'Kennzeichen ist Pflicht'
   WHEN contains({_PLATE},'-') THEN 'Kennzeichen bitte ohne ''-'' eingeben'
   WHEN regexp_matches({_PLATE},'\\s') THEN 'Kennzeichen bitte ohne Leerzeichen eingeben'
   WHEN NOT regexp_full_match({_PLATE},'[A-Z0-9ÄÖÜ]+') THEN 'Kennzeichen nur Buchstaben/Zahlen (ohne Sonderzeichen)'
   WHEN length({_PLATE}) < 3 THEN 'Kennzeichen zu kurz' END AS plate_err,
  CASE WHEN a.product_type IS NOT NULL AND lower(trim(coalesce(nullif(a.product_type,''),'euro'))) NOT IN ('euro','h1','gitterbox')
   THEN 'product_type invalid' END AS product_err,
  CASE WHEN {_CODE} IS NOT NULL AND NOT regexp_full_match({_CODE}, '[A-Z0-9]{{2}}')
   THEN 'Lagermitarbeiter muss genau 2 Zeichen haben (Buchstaben/Zahlen)' END AS code_err
 FROM lg a LEFT JOIN booking_cases c ON c.id=a.case_id
 LEFT JOIN (SELECT id, CASE WHEN role<>'admin' AND location_id IS NOT NULL AND location_id<>0 THEN location_id END AS lock FROM users) lk ON lk.id=a.actor_id
 LEFT JOIN perm p ON p.user_id=a.actor_id AND p.path={_PERM_PATH}
 LEFT JOIN perm rq ON rq.user_id=a.actor_id AND rq.path='cases.require_employee_code'),
walk AS (SELECT case_id, CAST(0 AS BIGINT) AS rn, max(s0) AS st, max(i0) AS qi, max(o0) AS qo, max(k0) AS kc, CAST(NULL AS INTEGER) AS action_id,
  CAST(NULL AS INTEGER) AS start_status, CAST(NULL AS VARCHAR) AS reason FROM act GROUP BY case_id
 UNION ALL
 SELECT case_id, rn, CASE WHEN reason IS NOT NULL THEN st WHEN action='claim' THEN 2 WHEN action='submit' THEN 3 WHEN action='approve' THEN 4
   WHEN action='cancel' THEN 0 ELSE st END, CASE WHEN reason IS NULL AND action='edit' THEN coalesce(n_in, qi) ELSE qi END,
  CASE WHEN reason IS NULL AND action='edit' THEN coalesce(n_out, qo) ELSE qo END,
  CASE WHEN reason IS NULL AND action IN ('edit','submit') AND sent THEN code ELSE kc END, action_id, st, reason
 FROM (SELECT w.case_id, a.rn, a.action, a.action_id, w.st, w.qi, w.qo, w.kc, a.qty_in AS n_in, a.qty_out AS n_out, a.code,
   a.employee_code IS NOT NULL AS sent,
   CASE WHEN NOT a.found THEN 'Not found' WHEN a.forbidden THEN 'Forbidden'
   WHEN a.action NOT IN ('edit','claim','submit','approve','set_translogica','cancel') THEN 'unknown action'
   WHEN NOT a.perm THEN 'Keine Berechtigung'
   WHEN a.action='edit' THEN CASE WHEN w.st NOT IN (1,2) THEN 'Nur in Status 1/2 editierbar' WHEN a.plate_err IS NOT NULL THEN a.plate_err
     WHEN a.qty_in < 0 THEN 'qty_in invalid' WHEN a.qty_out < 0 THEN 'qty_out invalid'
     WHEN a.non_exchangeable_qty < 0 THEN 'non_exchangeable_qty invalid'
     WHEN w.st <> 2 AND a.non_exchangeable_qty IS NOT NULL THEN 'non_exchangeable_qty nur in Status 2 editierbar'
     WHEN a.non_exchangeable_qty > {_ROOM} THEN 'non_exchangeable_qty darf positives Soll nicht übersteigen'
     WHEN a.product_err IS NOT NULL THEN a.product_err
     WHEN a.employee_code IS NOT NULL AND w.st <> 2 THEN 'employee_code nur in Status 2 editierbar'
     WHEN a.code_err IS NOT NULL THEN a.code_err
     WHEN a.employee_code IS NOT NULL AND a.req AND a.code IS NULL THEN 'Lagermitarbeiter (2-stellig) ist bei Status 2 Pflicht' END
   WHEN a.action='claim' THEN CASE WHEN w.st<>1 THEN 'Nur aus Status 1 möglich' END
   WHEN a.action='submit' THEN CASE WHEN w.st<>2 THEN 'Nur aus Status 2 möglich'
     WHEN a.non_exchangeable_qty < 0 THEN 'non_exchangeable_qty invalid'
     WHEN a.non_exchangeable_qty > greatest(coalesce(w.qi,0) - coalesce(w.qo,0), 0) THEN 'non_exchangeable_qty darf positives Soll nicht übersteigen'
     WHEN a.code_err IS NOT NULL THEN a.code_err
     WHEN a.req AND CASE WHEN a.employee_code IS NOT NULL THEN a.code ELSE w.kc END IS NULL THEN 'Lagermitarbeiter (2-stellig) ist bei Status 2 Pflicht' END
   WHEN a.action='approve' THEN CASE WHEN w.st<>3 THEN 'Nur aus Status 3 möglich' END
   WHEN a.action='set_translogica' THEN CASE WHEN w.st<>4 THEN 'Nur für gebuchte Vorgänge möglich'
     WHEN a.translogica_transferred IS NULL THEN 'translogica_transferred must be boolean' END
   ELSE CASE w.st WHEN 4 THEN 'Gebuchte Vorgänge können nicht storniert werden' WHEN 0 THEN 'Vorgang ist bereits storniert' END END AS reason
  FROM walk w JOIN act a ON a.case_id=w.case_id AND a.rn=w.rn+1) x),
outc AS (SELECT a.*, w.start_status, w.st AS end_status, w.reason FROM act a JOIN walk w ON w.case_id=a.case_id AND w.rn=a.rn),
ok AS (SELECT * FROM outc WHERE reason IS NULL),
upd AS (SELECT case_id, max_by(end_status, rn) AS status,
  max_by(department_id, rn) FILTER (WHERE action='edit' AND coalesce(department_id,0)<>0) AS department_id,
  max_by(upper(trim(license_plate)), rn) FILTER (WHERE action='edit' AND license_plate IS NOT NULL) AS license_plate,
  max_by(trim(entrepreneur), rn) FILTER (WHERE action='edit' AND nullif(trim(entrepreneur),'') IS NOT NULL) AS entrepreneur,
  max_by(trim(note), rn) FILTER (WHERE action='edit' AND nullif(trim(note),'') IS NOT NULL) AS note,
  max_by(qty_in, rn) FILTER (WHERE action='edit' AND qty_in IS NOT NULL) AS qty_in,
  max_by(qty_out, rn) FILTER (WHERE action='edit' AND qty_out IS NOT NULL) AS qty_out,
  max_by(lower(trim(coalesce(nullif(product_type,''),'euro'))), rn) FILTER (WHERE action='edit' AND product_type IS NOT NULL) AS product_type,
  max_by(non_exchangeable_qty, rn) FILTER (WHERE action IN ('edit','submit') AND non_exchangeable_qty IS NOT NULL) AS non_exchangeable_qty,
  bool_or(action IN ('edit','submit') AND employee_code IS NOT NULL) AS code_sent,
  max_by(coalesce(code,''), rn) FILTER (WHERE action IN ('edit','submit') AND employee_code IS NOT NULL) AS employee_code,
  max_by(actor_id, rn) FILTER (WHERE action='claim') AS claimed_by, max_by(actor_id, rn) FILTER (WHERE action='submit') AS submitted_by,
  max_by(actor_id, rn) FILTER (WHERE action='approve') AS approved_by, max_by(action, rn) AS applied_action, max_by(ts, rn) AS updated_at
 FROM ok GROUP BY case_id)
"""


_CASE_ROWS = """SELECT c.id, c.location_id, coalesce(u.department_id, c.department_id) AS department_id, c.created_by, coalesce(u.status, c.status) AS status,
 coalesce(u.license_plate, c.license_plate) AS license_plate, coalesce(u.entrepreneur, c.entrepreneur) AS entrepreneur, coalesce(u.note, c.note) AS note,
 coalesce(u.qty_in, c.qty_in) AS qty_in, coalesce(u.qty_out, c.qty_out) AS qty_out,
 coalesce(u.non_exchangeable_qty, c.non_exchangeable_qty) AS non_exchangeable_qty, coalesce(u.product_type, c.product_type) AS product_type,
 CASE WHEN u.code_sent THEN nullif(u.employee_code,'') ELSE c.employee_code END AS employee_code, c.created_at, c.receipt_no,
 coalesce(u.claimed_by, c.claimed_by) AS claimed_by, coalesce(u.submitted_by, c.submitted_by) AS submitted_by,
 coalesce(u.approved_by, c.approved_by) AS approved_by, u.applied_action, u.updated_at
FROM booking_cases c LEFT JOIN upd u ON u.case_id=c.id"""


@register("case_log_replay", _log_sql() + "SELECT action_id, case_id, actor_id, action, ts, start_status, end_status, reason IS NULL AS accepted, reason FROM outc")
def case_log_replay(t):
    """B6 with payloads: the outcome of every action of the whole log, a third of it on one case."""
    out = payload_replay.replay(t.case_log, t.booking_cases, t.users, t.roles)
    return out.select("action_id", "case_id", "actor_id", "action", "ts", "start_status", "end_status", "accepted", "reason")


@register("case_batch_apply", _log_sql() + _CASE_ROWS)
def case_batch_apply(t):
    """The whole log applied as one batch, several actions and edits per case; every case's new row."""
    return payload_replay.apply_log(t.case_log, t.booking_cases, t.users, t.roles)[0]


@register("case_batch_commit", _log_sql(with_locations=True) + f""",
x AS (SELECT o.case_id, c.location_id, row_number() OVER (ORDER BY o.ts, o.action_id) + 900 AS seq FROM ok o JOIN booking_cases c ON c.id=o.case_id
  WHERE o.action='approve'),
n AS (SELECT x.case_id, {_RNO} AS rno FROM x LEFT JOIN locations l ON l.id=x.location_id)
SELECT c.id, coalesce(u.status, c.status) AS status, coalesce(n.rno, c.receipt_no) AS receipt_no, coalesce(u.approved_by, c.approved_by) AS approved_by
FROM booking_cases c LEFT JOIN upd u ON u.case_id=c.id LEFT JOIN n ON n.case_id=c.id""")
def case_batch_commit(t):
    """B5 + B3: the whole log committed as one batch; approvals numbered from 901."""
    snap, _, _ = payload_replay.commit_log(t.case_log, t.booking_cases, t.users, t.roles, t.locations, receipt_start=901, day=DAY)
    return snap.select("id", "status", "receipt_no", "approved_by")


@register("case_log_postings", _log_sql(with_locations=True) + f""",
x AS (SELECT c.id, c.location_id, coalesce(u.department_id, c.department_id) AS department_id, coalesce(u.note, c.note) AS note,
  coalesce(u.license_plate, c.license_plate) AS license_plate, coalesce(u.entrepreneur, c.entrepreneur) AS entrepreneur,
  coalesce(u.qty_in, c.qty_in, 0) AS qi, coalesce(u.qty_out, c.qty_out, 0) AS qo, coalesce(u.non_exchangeable_qty, c.non_exchangeable_qty, 0) AS nx,
  coalesce(u.product_type, c.product_type, 'euro') AS product_type, o.actor_id, row_number() OVER (ORDER BY o.ts, o.action_id) + 900 AS seq
  FROM ok o JOIN booking_cases c ON c.id=o.case_id JOIN upd u ON u.case_id=c.id WHERE o.action='approve'),
n AS (SELECT x.*, greatest(qi - nx, 0) AS booked, {_RNO} AS rno FROM x LEFT JOIN locations l ON l.id=x.location_id)
SELECT id AS case_id, location_id, department_id, actor_id AS user_id, 'IN' AS type, booked AS quantity, note, rno AS receipt_no, license_plate, entrepreneur,
 1 AS line_no, product_type FROM n WHERE booked > 0
UNION ALL
SELECT id, location_id, department_id, actor_id, 'OUT', qo, note, rno, license_plate, entrepreneur, CASE WHEN booked > 0 THEN 2 ELSE 1 END, product_type
FROM n WHERE qo > 0""")
def case_log_postings(t):
    """B5 → B3 → B1 on the whole log: the ledger lines of its approvals, with what edits and submits set before them."""
    _, lines, _ = payload_replay.commit_log(t.case_log, t.booking_cases, t.users, t.roles, t.locations, receipt_start=901, day=DAY)
    return lines.drop("booking_group_id")


_EDITS = "SELECT action_id, case_id, actor_id, 'edit' AS action, ts, department_id, license_plate, entrepreneur, note, qty_in, qty_out, non_exchangeable_qty, employee_code, product_type, CAST(NULL AS BOOLEAN) AS translogica_transferred FROM case_edits"


@register("case_edit_rejects", _log_sql("case_edits", _EDITS) + "SELECT action_id, case_id, actor_id, reason FROM outc WHERE reason IS NOT NULL")
def case_edit_rejects(t):
    """B5 edit: the rejected ones of all logged edits, applied in order (full rule order)."""
    return lifecycle.apply_edits(t.case_edits, t.booking_cases, t.users, t.roles)[1]


@register("case_edit_apply", _log_sql("case_edits", _EDITS) + """SELECT id, department_id, license_plate, entrepreneur, note, qty_in, qty_out, product_type,
 non_exchangeable_qty, employee_code, updated_at FROM (""" + _CASE_ROWS + ") z WHERE EXISTS (SELECT 1 FROM case_edits e WHERE e.case_id=z.id)")
def case_edit_apply(t):
    """B5 edit + W3: the edited cases after all their edits in order (COALESCE patches)."""
    touched = t.booking_cases.join(t.case_edits.select(F.col("case_id").alias("id")), "id", "left_semi")
    new, _ = lifecycle.apply_edits(t.case_edits, touched, t.users, t.roles)
    return new.select("id", "department_id", "license_plate", "entrepreneur", "note", "qty_in", "qty_out",
                      "product_type", "non_exchangeable_qty", "employee_code", "updated_at")
