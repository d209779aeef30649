"""Registered queries: receipt numbering, posting, transfers and case intake."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from carrierbook.operators import posting
from carrierbook.plans.catalog import register
from carrierbook.plans.queries_access import PERM_SQL
from carrierbook.sources.fixtures import with_prefix

DAY = dt.date(2024, 2, 1)
APPROVER = 1

_RNO = ("'ICS' || upper(coalesce(nullif(regexp_extract(l.name,'([A-Za-zÄÖÜ])',1),''),'L')) || "
        "coalesce(nullif(regexp_extract(l.name,'([0-9]+)',1),''), CAST(a.location_id AS VARCHAR)) || '-20240201-' || "
        "lpad(CAST(a.seq AS VARCHAR), CAST(greatest(6, length(CAST(a.seq AS VARCHAR))) AS INTEGER), '0')")
_NUMBERED = with_prefix("booking_cases", "locations") + f""",
a AS (SELECT c.*, row_number() OVER (ORDER BY c.id) AS seq FROM booking_cases c WHERE c.status=3),
n AS (SELECT a.*, {_RNO} AS rno FROM a LEFT JOIN locations l ON l.id=a.location_id)
"""


def _gid(expr: str) -> str:
    h = f"md5({expr})"
    return (f"substr({h},1,8)||'-'||substr({h},9,4)||'-'||substr({h},13,4)||'-'||substr({h},17,4)||'-'||substr({h},21,12)")


def _approvals(t):
    """Approve every case in review (status 3) by user 1, numbered in case-id order."""
    c = t.booking_cases.where(F.col("status") == 3).withColumn("approved_by", F.lit(APPROVER))
    return posting.assign_receipt_numbers(c, t.locations, order=["id"], start=1, day=DAY)


@register("receipt_numbers", _NUMBERED + "SELECT id, CAST(seq AS BIGINT) AS receipt_seq, rno AS receipt_no FROM n")
def receipt_numbers(t):
    """B3 + D3: consecutive receipt numbers for all cases in review, in case-id order."""
    return _approvals(t).select("id", "receipt_seq", "receipt_no")


_QIN = "greatest(coalesce(qty_in,0)-coalesce(non_exchangeable_qty,0),0)"


@register("posting", _NUMBERED + f"""
SELECT id AS case_id, location_id, department_id, 1 AS user_id, 'IN' AS type, {_QIN} AS quantity, note, rno AS receipt_no,
 license_plate, entrepreneur, {_gid("'case|' || id || '|' || rno")} AS booking_group_id, 1 AS line_no,
 coalesce(product_type,'euro') AS product_type FROM n WHERE {_QIN} > 0
UNION ALL
SELECT id, location_id, department_id, 1, 'OUT', coalesce(qty_out,0), note, rno, license_plate, entrepreneur,
 {_gid("'case|' || id || '|' || rno")}, CASE WHEN {_QIN} > 0 THEN 2 ELSE 1 END, coalesce(product_type,'euro')
FROM n WHERE coalesce(qty_out,0) > 0""")
def posting_lines(t):
    """B1: ledger lines of all cases in review approved in one batch."""
    return posting.post_cases(_approvals(t))


_TRANSFER_REASON = """CASE WHEN NOT coalesce(p.effective,false) THEN 'Keine Berechtigung'
 WHEN coalesce(r.to_location_id,0)=0 THEN 'to_location_id required'
 WHEN r.qty IS NULL OR r.qty < 1 THEN 'qty invalid'
 WHEN nullif(trim(r.note),'') IS NULL THEN 'Notiz ist Pflicht'
 WHEN coalesce(r.from_location_id,0)<>0 AND r.from_location_id=r.to_location_id THEN 'from_location_id und to_location_id dürfen nicht identisch sein'
 WHEN lk.lock IS NOT NULL AND r.to_location_id<>lk.lock THEN 'Forbidden'
 WHEN lk.lock IS NOT NULL AND coalesce(r.from_location_id,0)<>0 AND r.from_location_id<>lk.lock THEN 'Forbidden' END"""


def _transfer_sql(actor: int) -> str:
    return PERM_SQL.replace("WITH ", "WITH " + with_prefix("transfer_requests")[5:].rstrip() + ",\n", 1) + f""",
lk AS (SELECT CASE WHEN role<>'admin' AND location_id IS NOT NULL AND location_id<>0 THEN location_id END AS lock FROM users WHERE id={actor}),
chk AS (SELECT r.*, {_TRANSFER_REASON} AS reason FROM transfer_requests r CROSS JOIN lk
 LEFT JOIN perm p ON p.user_id={actor} AND p.path='cases.internal_transfer')
"""


@register("transfer_lines", _transfer_sql(1) + f"""
SELECT request_id, from_location_id AS location_id, CAST(NULL AS INTEGER) AS department_id, 1 AS user_id, 'OUT' AS type, qty AS quantity,
 trim(note) AS note, CAST(NULL AS VARCHAR) AS receipt_no, CAST(NULL AS VARCHAR) AS license_plate, CAST(NULL AS VARCHAR) AS entrepreneur,
 {_gid("'transfer|' || request_id")} AS booking_group_id, 1 AS line_no, 'euro' AS product_type, 'transfer' AS mode
FROM chk WHERE reason IS NULL AND coalesce(from_location_id,0)<>0
UNION ALL
SELECT request_id, to_location_id, NULL, 1, 'IN', qty, trim(note), NULL, NULL, NULL, {_gid("'transfer|' || request_id")},
 CASE WHEN coalesce(from_location_id,0)<>0 THEN 2 ELSE 1 END, 'euro',
 CASE WHEN coalesce(from_location_id,0)<>0 THEN 'transfer' ELSE 'in_only' END FROM chk WHERE reason IS NULL""")
def transfer_lines(t):
    """B2: transfer requests by the admin (user 1) as double-entry ledger lines."""
    return posting.internal_transfers(t.transfer_requests, t.users, t.roles, actor_id=1)[0]


@register("transfer_rejects", _transfer_sql(4) + "SELECT request_id, 4 AS actor_id, reason FROM chk WHERE reason IS NOT NULL")
def transfer_rejects(t):
    """B2 + Q6: rejects (first failing rule) of the same requests by user 4 (full access, locked to a location)."""
    return posting.internal_transfers(t.transfer_requests, t.users, t.roles, actor_id=4)[1]


_INTAKE_REASON = """CASE WHEN NOT coalesce(p.effective,false) THEN 'Keine Berechtigung'
 WHEN coalesce(r.location_id,0)=0 OR coalesce(r.department_id,0)=0 THEN 'location_id + department_id required'
 WHEN upper(trim(coalesce(r.license_plate,'')))='' THEN 'Kennzeichen ist Pflicht'
 WHEN contains(upper(trim(coalesce(r.license_plate,''))),'-') THEN 'Kennzeichen bitte ohne ''-'' eingeben'
 WHEN regexp_matches(upper(trim(coalesce(r.license_plate,''))),'\\s') THEN 'Kennzeichen bitte ohne Leerzeichen eingeben'
 WHEN NOT regexp_full_match(upper(trim(coalesce(r.license_plate,''))),'[A-Z0-9ÄÖÜ]+') THEN 'Kennzeichen nur Buchstaben/Zahlen (ohne Sonderzeichen)'
 WHEN length(upper(trim(coalesce(r.license_plate,'')))) < 3 THEN 'Kennzeichen zu kurz'
 WHEN coalesce(r.qty_in,0) < 0 THEN 'qty_in invalid'
 WHEN coalesce(r.qty_out,0) < 0 THEN 'qty_out invalid'
 WHEN coalesce(r.qty_in,0)=0 AND coalesce(r.qty_out,0)=0 THEN 'qty_in oder qty_out muss > 0 sein'
 WHEN lower(trim(coalesce(nullif(r.product_type,''),'euro'))) NOT IN ('euro','h1','gitterbox') THEN 'product_type invalid'
 WHEN nullif(trim(r.employee_code),'') IS NOT NULL AND NOT regexp_full_match(upper(trim(r.employee_code)),'[A-Z0-9]{2}') THEN 'Lagermitarbeiter muss genau 2 Zeichen haben (Buchstaben/Zahlen)'
 WHEN lk.lock IS NOT NULL AND r.location_id<>lk.lock THEN 'Forbidden' END"""


def _intake_sql(actor: int) -> str:
    return PERM_SQL.replace("WITH ", "WITH " + with_prefix("case_requests")[5:].rstrip() + ",\n", 1) + f""",
lk AS (SELECT CASE WHEN role<>'admin' AND location_id IS NOT NULL AND location_id<>0 THEN location_id END AS lock FROM users WHERE id={actor}),
chk AS (SELECT r.*, {_INTAKE_REASON} AS reason FROM case_requests r CROSS JOIN lk
 LEFT JOIN perm p ON p.user_id={actor} AND p.path='cases.create')
"""


@register("intake_cases", _intake_sql(1) + """
SELECT CAST(row_number() OVER (ORDER BY request_id) + 1000000 - 1 AS INTEGER) AS id, request_id, location_id, department_id, 1 AS created_by,
 1 AS status, upper(trim(license_plate)) AS license_plate, CAST(NULL AS VARCHAR) AS entrepreneur, CAST(NULL AS VARCHAR) AS note,
 coalesce(qty_in,0) AS qty_in, coalesce(qty_out,0) AS qty_out, 0 AS non_exchangeable_qty,
 lower(trim(coalesce(nullif(product_type,''),'euro'))) AS product_type, upper(nullif(trim(employee_code),'')) AS employee_code
FROM chk WHERE reason IS NULL""")
def intake_cases(t):
    """B4 + Q9: valid requests by the admin become status-1 cases with ids from 1000000."""
    return posting.intake_cases(t.case_requests, t.users, t.roles, actor_id=1, next_case_id=1000000)[0]


@register("intake_rejects", _intake_sql(2) + "SELECT request_id, 2 AS actor_id, reason FROM chk WHERE reason IS NOT NULL")
def intake_rejects(t):
    """Q9: first failing rule of each rejected request by user 2 (location-locked)."""
    return posting.intake_cases(t.case_requests, t.users, t.roles, actor_id=2)[2]
