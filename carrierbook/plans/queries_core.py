"""Registered queries: stock balances (A1)."""

from __future__ import annotations

from carrierbook.operators import balance
from carrierbook.plans.catalog import register
from carrierbook.sources.fixtures import with_prefix



def _totals(key: str, product: str, location: str = "true") -> str:
    """The ledger totalled per key for one product; dimensions are joined to the totals."""
    return f""",
totals AS (SELECT {key} AS k, sum(quantity) FILTER (type = 'IN') AS received, sum(quantity) FILTER (type = 'OUT') AS issued
  FROM bookings WHERE ifnull(product_type, 'euro') = '{product}' AND {location} GROUP BY ALL),
balance AS (SELECT k, CAST(ifnull(received, 0) AS BIGINT) AS ins, CAST(ifnull(issued, 0) AS BIGINT) AS outs FROM totals)"""


def _per(dimension: str, label: str, only: str = "true") -> str:
    """Every row of a dimension, with zeros where the ledger has nothing."""
    return f"""
SELECT x.id AS {label}_id, x.name AS {label}, ifnull(ins, 0) AS ins, ifnull(outs, 0) AS outs, ifnull(ins - outs, 0) AS saldo
FROM (SELECT id, name FROM {dimension} WHERE {only}) x LEFT JOIN balance ON k = x.id"""


@register("stock_location", with_prefix("departments", "bookings") + _totals("department_id", "euro", "location_id = 3")
          + _per("departments", "department"))
def stock_location(t):
    """Departments at location 3, euro."""
    return balance.stock(t.bookings, mode="location", product="euro", location_id=3, departments=t.departments)


@register("stock_overall", with_prefix("departments", "bookings") + _totals("department_id", "euro") + _per("departments", "department"))
def stock_overall(t):
    """Departments over all locations, euro."""
    return balance.stock(t.bookings, mode="overall", product="euro", departments=t.departments)


@register("stock_overall_locked_h1", with_prefix("departments", "bookings") + _totals("department_id", "h1", "location_id = 7")
          + _per("departments", "department"))
def stock_overall_locked_h1(t):
    """A1b with a user location lock (7), product h1."""
    return balance.stock(t.bookings, mode="overall", product="h1", lock_location=7, departments=t.departments)


@register("stock_location_total", with_prefix("locations", "bookings") + _totals("location_id", "euro") + _per("locations", "location"))
def stock_location_total(t):
    """Per location, internal transfers included, euro."""
    return balance.stock(t.bookings, mode="location_total", product="euro", locations=t.locations)


@register("stock_location_total_locked_gitterbox", with_prefix("locations", "bookings") + _totals("location_id", "gitterbox")
          + _per("locations", "location", "id = 12"))
def stock_location_total_locked(t):
    """A1c locked to location 12, product gitterbox."""
    return balance.stock(t.bookings, mode="location_total", product="gitterbox", lock_location=12, locations=t.locations)


@register("stock_entrepreneur", with_prefix("entrepreneurs", "bookings") + _totals("entrepreneur", "euro") + """
SELECT k AS entrepreneur, ins, outs, ins - outs AS saldo FROM balance SEMI JOIN entrepreneurs ON name = k WHERE k <> ''""")
def stock_entrepreneur(t):
    """A1d: per known partner, euro."""
    return balance.stock(t.bookings, mode="entrepreneur", product="euro", entrepreneurs=t.entrepreneurs)
