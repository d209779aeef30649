"""Ledger exports (S3, S4) and dimension lists.

The reference builds each export in one process; here the rows are a
DataFrame and the writers are Spark's distributed CSV / Parquet writers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carrierbook.sources import schema as S

# Export field order and the labelled export's column headers.
EXPORT_FIELDS = ["created_at", "receipt_no", "license_plate", "entrepreneur", "username", "type", "quantity", "note"]
EXPORT_LABELS = {
    "created_at": "Datum/Zeit", "receipt_no": "Belegnr.", "license_plate": "Kennzeichen",
    "entrepreneur": "Unternehmer", "username": "Benutzer", "type": "Typ", "quantity": "Menge", "note": "Notiz",
}


def dim_list(df: DataFrame, cols: list[str], order: str = "name") -> DataFrame:
    """A dimension's listed columns sorted by name (ties by id for a stable order)."""
    keys = [order] + (["id"] if "id" in df.columns and order != "id" else [])
    return df.select(*cols).orderBy(*keys)


def ledger_rows(bookings: DataFrame, users: DataFrame, *, location_id: int | None = None,
                department_id: int | None = None, keep_keys: bool = False) -> DataFrame:
    """S3 rows: the export fields of ledger lines (user name with placeholder), ascending id."""
    b = bookings
    if location_id is not None:
        b = b.where(F.col("location_id") == F.lit(location_id))
    if department_id is not None:
        b = b.where(F.col("department_id") == F.lit(department_id))
    u = users.select(F.col("id").alias("_uid"), F.col("username").alias("_uname"))
    j = b.join(u, b["user_id"] == u["_uid"], "left").withColumn(
        "username", F.coalesce(F.col("_uname"), F.lit(S.DELETED_USER)))
    keys = ["id", "location_id", "department_id"] if keep_keys else ["id"]
    return j.select(*keys, *EXPORT_FIELDS)


def export_ledger(bookings: DataFrame, users: DataFrame, locations: DataFrame, departments: DataFrame,
                  location_id: int, department_id: int) -> DataFrame:
    """S3: one location × department ledger in export order; unknown names fail like the reference (404)."""
    loc = locations.where(F.col("id") == F.lit(location_id)).limit(1).count()
    dep = departments.where(F.col("id") == F.lit(department_id)).limit(1).count()
    if not loc or not dep:
        raise LookupError("location/department not found")
    return ledger_rows(bookings, users, location_id=location_id, department_id=department_id).orderBy("id")


def labelled(rows: DataFrame) -> DataFrame:
    """The same rows under the labelled export's column headers."""
    return rows.select(*[F.col(c).alias(EXPORT_LABELS[c]) for c in EXPORT_FIELDS])


def write_csv(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write export rows as CSV with a header (distributed: one file per task)."""
    rows.write.mode(mode).option("header", True).csv(path)


def write_company_export(bookings: DataFrame, users: DataFrame, path: str, fmt: str = "parquet") -> None:
    """S3 whole-company form: every location × department in one job, one folder per pair.

    Rows are range-partitioned on (location, department, id) and sorted inside each task, so each
    folder's files hold ascending ids and a hot pair spreads over tasks.
    """
    rows = ledger_rows(bookings, users, keep_keys=True)
    order = ["location_id", "department_id", "id"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    w = rows.write.mode("overwrite").partitionBy("location_id", "department_id")
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.parquet(path)
