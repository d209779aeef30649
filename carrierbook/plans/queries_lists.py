"""Registered queries: receipt roll-up and paging, receipt documents,
partner history, plates, case list and search."""

from __future__ import annotations

from pyspark.sql import functions as F

from carrierbook.operators import cases, history, receipts
from carrierbook.plans.catalog import register
from carrierbook.sources.fixtures import VIEW_SQL, with_prefix

# Case table as the reference stores it, with the transfer flag (fixture view).
FLAG_SQL = "booking_cases_t AS (" + VIEW_SQL["booking_cases_flagged"] + ")"


def cases_with_flag(t):
    return t.booking_cases_flagged


def _rolled(lines: str) -> str:
    """``rolled``: ledger totals per receipt, joined to facts per receipt about posters and cases."""
    return f""",
picked AS (SELECT * FROM bookings WHERE {lines}),
totals AS (SELECT receipt_no, min(id) AS id, min(created_at) AS created_at, max(license_plate) AS license_plate,
  max(entrepreneur) AS entrepreneur, max(note) AS note, max(ifnull(product_type, 'euro')) AS product_type,
  sum(quantity) FILTER (type = 'IN') AS received, sum(quantity) FILTER (type = 'OUT') AS issued FROM picked GROUP BY ALL),
posters AS (SELECT receipt_no, max(ifnull(username, '(gelöscht)')) AS user_name
  FROM (SELECT DISTINCT receipt_no, user_id FROM picked) LEFT JOIN users ON id = user_id GROUP BY ALL),
parties AS (SELECT receipt_no, part, max(ifnull(username, '(gelöscht)')) AS name
  FROM (UNPIVOT (SELECT receipt_no, id AS case_id, ifnull(created_by, -1) AS created_by, ifnull(approved_by, -1) AS approved_by
                 FROM booking_cases WHERE receipt_no IS NOT NULL) ON created_by, approved_by INTO NAME part VALUE who)
  LEFT JOIN users ON id = who GROUP BY ALL),
facts AS (SELECT receipt_no, count(*) AS n_cases, max(employee_code) AS employee_code FROM booking_cases GROUP BY ALL),
rolled AS (SELECT t.id, t.created_at, t.receipt_no, license_plate, entrepreneur, note, user_name,
  ifnull(c.name, '(gelöscht)') AS aviso_created_by, ifnull(a.name, '(gelöscht)') AS aviso_approved_by, employee_code, product_type,
  CAST(ifnull(received, 0) * ifnull(n_cases, 1) AS BIGINT) AS qty_in, CAST(ifnull(issued, 0) * ifnull(n_cases, 1) AS BIGINT) AS qty_out
  FROM totals t JOIN posters p ON p.receipt_no IS NOT DISTINCT FROM t.receipt_no LEFT JOIN facts f ON f.receipt_no = t.receipt_no
  LEFT JOIN parties c ON c.receipt_no = t.receipt_no AND c.part = 'created_by'
  LEFT JOIN parties a ON a.receipt_no = t.receipt_no AND a.part = 'approved_by')
"""


@register("receipt_rollup", with_prefix("users", "bookings") + _rolled(
    "department_id = 2 AND CAST(created_at AS DATE) BETWEEN DATE '1997-01-01' AND DATE '1999-12-31'") + "SELECT * FROM rolled")
def receipt_rollup(t):
    """A2 + F5 + J3: department 2, all locations, 1997-01-01..1999-12-31, every receipt."""
    return receipts.receipt_rollup(t.bookings, t.booking_cases, t.users, department_id=2, location_id=-1,
                                   date_from_="1997-01-01", date_to_="1999-12-31")


@register("receipt_rollup_search", with_prefix("users", "bookings") + _rolled(
    "department_id = 4 AND contains(lower(entrepreneur), 'plier#000000003') AND contains(lower(license_plate), 'h2') "
    "AND contains(lower(receipt_no), 'icsn')") + "SELECT * FROM rolled")
def receipt_rollup_search(t):
    """A2 + F6: department 4, all locations, partner / plate / receipt substrings."""
    return receipts.receipt_rollup(t.bookings, t.booking_cases, t.users, department_id=4, location_id=-1,
                                   entrepreneur="plier#000000003", license_plate="h2", receipt_no="icsn")


@register("receipt_page", with_prefix("users", "bookings") + _rolled("department_id = 1 AND location_id = 5") + """
SELECT * EXCLUDE (place, n), n > 60 AS has_more
FROM (SELECT *, row_number() OVER (ORDER BY id DESC, receipt_no) AS place, count(*) OVER () AS n FROM rolled)
WHERE place BETWEEN 41 AND 60""")
def receipt_page(t):
    """A2 + L2: department 1 at location 5, third page of 20 with the look-ahead flag."""
    r = receipts.receipt_rollup(t.bookings, t.booking_cases, t.users, department_id=1, location_id=5)
    return receipts.page(r, [F.col("id").desc(), F.col("receipt_no").asc_nulls_last()], limit=20, offset=40)


@register("ledger_receipts", with_prefix("users", "bookings", "locations", "departments", "entrepreneurs") + """,
known AS (SELECT * REPLACE (ifnull(product_type, 'euro') AS product_type, ifnull(line_no, 999999) AS line_no)
  FROM bookings SEMI JOIN locations ON locations.id = location_id WHERE receipt_no IS NOT NULL),
heads AS (SELECT DISTINCT ON (receipt_no) * FROM known ORDER BY receipt_no, line_no, id, created_at NULLS FIRST, location_id,
  department_id NULLS FIRST, user_id NULLS FIRST, license_plate NULLS FIRST, entrepreneur NULLS FIRST, note NULLS FIRST, product_type),
totals AS (SELECT receipt_no, count(*) AS n, sum(quantity) FILTER (type = 'IN') AS received,
  sum(quantity) FILTER (type = 'OUT') AS issued FROM known GROUP BY ALL),
cases AS (SELECT receipt_no, count(*) AS n_cases, min({'a': ifnull(created_by, -1), 'b': ifnull(employee_code, ''),
  'c': ifnull(non_exchangeable_qty, -1)}) AS first FROM booking_cases WHERE receipt_no IS NOT NULL GROUP BY ALL),
facts AS (SELECT receipt_no, n_cases, first.a AS creator, nullif(first.b, '') AS employee_code, nullif(first.c, -1) AS not_returned FROM cases)
SELECT receipt_no, h.created_at, l.name AS location, h.location_id, ifnull(d.name, '(gelöschte Abteilung)') AS department,
 ifnull(poster.username, '(gelöscht)') AS username, h.license_plate, h.entrepreneur, e.street AS entrepreneur_street,
 e.postal_code AS entrepreneur_postal_code, e.city AS entrepreneur_city, ifnull(creator.username, '(gelöscht)') AS aviso_created_by,
 employee_code, h.note, CAST(ifnull(received, 0) * ifnull(n_cases, 1) AS BIGINT) AS qty_in,
 CAST(ifnull(issued, 0) * ifnull(n_cases, 1) AS BIGINT) AS qty_out, ifnull(not_returned, 0) AS non_exchangeable_qty, h.product_type,
 CAST(n * ifnull(n_cases, 1) AS BIGINT) AS line_count
FROM totals JOIN heads h USING (receipt_no) LEFT JOIN facts USING (receipt_no) LEFT JOIN locations l ON l.id = h.location_id
 LEFT JOIN departments d ON d.id = h.department_id LEFT JOIN entrepreneurs e ON e.name = h.entrepreneur
 LEFT JOIN users poster ON poster.id = h.user_id LEFT JOIN users creator ON creator.id = facts.creator""")
def ledger_receipts(t):
    """D1 (+J3, J5): every ledger receipt document header with totals."""
    return receipts.ledger_receipts(t.bookings, t.booking_cases, t.users, t.locations, t.departments, t.entrepreneurs)


@register("receipt_lines", with_prefix("bookings") + """
SELECT receipt_no, CAST(row_number() OVER (PARTITION BY receipt_no ORDER BY COALESCE(line_no,999999), id, type, quantity) AS BIGINT) AS position,
 id, line_no, type, quantity FROM bookings WHERE receipt_no IS NOT NULL""")
def receipt_lines(t):
    """Every receipt's lines with their position (range-partitioned numbering)."""
    return receipts.receipt_lines(t.bookings)


def _history(cases: str) -> str:
    """``history``: sums per department id first, named and summed again per department name."""
    return f""",
per_id AS (SELECT entrepreneur, license_plate, ifnull(product_type, 'euro') AS product_type, department_id, max(created_at) AS seen,
  sum(qty_in) AS received, sum(qty_out) AS issued, sum(non_exchangeable_qty) FILTER (qty_in > qty_out) AS kept
  FROM booking_cases WHERE status > 0 AND length(entrepreneur) > 0 AND {cases} GROUP BY ALL),
named AS (SELECT per_id.*, ifnull(name, '(gelöschte Abteilung)') AS department FROM per_id LEFT JOIN departments ON id = department_id),
sums AS (SELECT max(seen) AS last_seen, entrepreneur, license_plate, product_type, department, CAST(ifnull(sum(received), 0) AS BIGINT) AS qty_in,
  CAST(ifnull(sum(issued), 0) AS BIGINT) AS qty_out, CAST(ifnull(sum(kept), 0) AS BIGINT) AS kept FROM named GROUP BY ALL),
history AS (SELECT * EXCLUDE (kept), qty_in - qty_out - kept AS soll FROM sums)
"""


@register("partner_history", with_prefix("booking_cases", "departments") + _history("true") + "SELECT * FROM history")
def partner_history(t):
    """A3 + F8: all locations, every group."""
    return history.partner_history(t.booking_cases, t.departments, location_id=-1)


@register("partner_history_newest", with_prefix("booking_cases", "departments") + _history("location_id = 4") + """
SELECT * FROM history QUALIFY row_number() OVER (ORDER BY last_seen DESC, entrepreneur, license_plate NULLS LAST, product_type, department) <= 500""")
def partner_history_newest(t):
    """A3 + L5: location 4, the 500 groups seen last (ties broken by the group keys)."""
    return history.newest_groups(history.partner_history(t.booking_cases, t.departments, location_id=4), 500)


@register("partner_history_filtered", with_prefix("booking_cases", "departments") + _history(
    "department_id = 3 AND contains(lower(entrepreneur), 'supplier#000000003') AND contains(lower(license_plate), 'hh1')") + "SELECT * FROM history")
def partner_history_filtered(t):
    """A3 with department, partner and plate filters."""
    return history.partner_history(t.booking_cases, t.departments, location_id=-1, department_id=3,
                                   entrepreneur="supplier#000000003", license_plate="hh1")


@register("plates", with_prefix("booking_cases") + """
SELECT DISTINCT license_plate FROM booking_cases WHERE trim(entrepreneur) <> '' AND location_id=3
 AND license_plate IS NOT NULL AND license_plate <> '' ORDER BY 1""")
def plates(t):
    """A4: distinct plates of the partner log at location 3."""
    return history.plates(history.entrepreneur_history(t.booking_cases), location_id=3)


# ``shown``: every case with its names; the four user references are looked up once, as rows.
_SHOWN = """,
parties AS (UNPIVOT (SELECT id AS case_id, created_by, claimed_by, submitted_by, approved_by FROM booking_cases_t)
  ON created_by, claimed_by, submitted_by, approved_by INTO NAME part VALUE who),
names AS (SELECT case_id, max(username) FILTER (part = 'created_by') AS n1, max(username) FILTER (part = 'claimed_by') AS n2,
  max(username) FILTER (part = 'submitted_by') AS n3, max(username) FILTER (part = 'approved_by') AS n4
  FROM parties JOIN users ON id = who GROUP BY ALL),
places AS (SELECT id AS place_id, name AS location FROM locations),
shown AS (SELECT t.*, ifnull(departments.name, '(gelöschte Abteilung)') AS department, location,
  ifnull(n1, '(gelöscht)') AS created_by_name, ifnull(n2, '(gelöscht)') AS claimed_by_name,
  ifnull(n3, '(gelöscht)') AS submitted_by_name, ifnull(n4, '(gelöscht)') AS approved_by_name
  FROM places JOIN booking_cases_t t ON t.location_id = place_id LEFT JOIN departments ON departments.id = t.department_id
  LEFT JOIN names ON case_id = t.id)
"""
_CASES = with_prefix("booking_cases", "departments", "locations", "users", "case_actions") + ", " + FLAG_SQL + _SHOWN


def _mentions(text: str) -> str:
    return f"contains(lower(concat_ws(chr(10), license_plate, entrepreneur, note)), '{text}')"


def _newest(rows: str) -> str:
    return f"SELECT * FROM shown WHERE {rows} QUALIFY row_number() OVER (ORDER BY id DESC) <= 500"


@register("case_search", _CASES + "SELECT * FROM shown WHERE " + _mentions("hh1"))
def case_search(t):
    """J1 + F1 + F4: all locations, text search 'HH1', every match (no row cap)."""
    return cases.list_cases(cases_with_flag(t), t.departments, t.locations, t.users, location_id=-1,
                            search="HH1", limit=None)


@register("case_list_newest", _CASES + _newest("location_id = 3 AND (id = 42 OR " + _mentions("42") + ")"))
def case_list_newest(t):
    """J1 + F4 (all-digit search also matches the id) + L1: location 3, newest 500."""
    return cases.list_cases(cases_with_flag(t), t.departments, t.locations, t.users, location_id=3, search="42")


@register("case_list_filtered", _CASES + _newest("location_id = 5 AND status = 4 AND translogica_transferred AND created_by = 130"))
def case_list_filtered(t):
    """J1 + F3: location 5, status 4, transferred, created by user 130."""
    return cases.list_cases(cases_with_flag(t), t.departments, t.locations, t.users, location_id=5, status=4,
                            translogica=True, mine_user_id=130)


@register("case_lookup", _CASES + "SELECT * FROM shown SEMI JOIN case_actions ON case_actions.case_id = shown.id")
def case_lookup(t):
    """F9 batch form: the cases named in the action log, enriched (semi join)."""
    keys = t.case_actions.select(F.col("case_id"))
    return cases.get_cases(cases_with_flag(t), t.departments, t.locations, t.users, keys)


@register("case_list_scoped", _CASES + _newest("location_id = 11 AND status = 2"))
def case_list_scoped(t):
    """F2 + J1 + L1: user 4's request for location 11 (its own lock), status 2, newest 500."""
    from carrierbook.operators import access
    scope = access.user_scope(t.users, t.roles)
    c = access.scope_rows(cases_with_flag(t), scope, user_id=4, requested_location=11)
    return cases.list_cases(c, t.departments, t.locations, t.users, location_id=None, status=2)


@register("case_list_scope_denied", _CASES + "SELECT * FROM shown WHERE false")
def case_list_scope_denied(t):
    """user 2 (locked, no all-locations right) asking for all locations gets nothing."""
    from carrierbook.operators import access
    scope = access.user_scope(t.users, t.roles)
    c = access.scope_rows(cases_with_flag(t), scope, user_id=2, requested_location=-1)
    return cases.list_cases(c, t.departments, t.locations, t.users, location_id=None)


@register("receipt_page_after", with_prefix("users", "bookings") + _rolled("department_id = 1 AND location_id = 5") + """
SELECT * EXCLUDE (place, n), n > 20 AS has_more
FROM (SELECT *, rank() OVER (ORDER BY id DESC) AS place, count(*) OVER () AS n FROM rolled WHERE id < 20000) WHERE place <= 20""")
def receipt_page_after(t):
    """A2 + L2 keyset form: the page of 20 receipts after id 20000 (newest first)."""
    r = receipts.receipt_rollup(t.bookings, t.booking_cases, t.users, department_id=1, location_id=5)
    return receipts.page_after(r, "id", 20000, limit=20)


@register("case_search_large_users", _CASES + "SELECT * FROM shown WHERE " + _mentions("hh2"))
def case_search_large_users(t):
    """J1 (one-lookup form for user tables above the broadcast threshold) + F4: search 'HH2'."""
    return cases.list_cases(cases_with_flag(t), t.departments, t.locations, t.users, location_id=-1,
                            search="HH2", limit=None, large_users=True)
