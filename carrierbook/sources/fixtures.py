"""Ledger tables derived from the driver's TPC-H-style tables.

The reference keeps its data in relational tables; the test driver ships
TPC-H-style Parquet instead.  The view texts below (documented in
FIXTURES.md) give rows in the reference's table shapes.  They only produce
input rows; every operator in this library works on any data of these
schemas.  The same texts are the ``WITH`` prefix of the DuckDB oracle, so both
engines see identical inputs.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carrierbook.sources import schema as S

# Driver tables the views read, with the columns they need (explicit schema:
# no inference, and the Parquet scan reads only these columns).
DRIVER_SCHEMAS = {
    "nation": T.StructType([T.StructField("n_nationkey", T.IntegerType()), T.StructField("n_name", T.StringType())]),
    "supplier": T.StructType([T.StructField("s_suppkey", T.LongType()), T.StructField("s_name", T.StringType()),
                              T.StructField("s_nationkey", T.IntegerType())]),
    "customer": T.StructType([T.StructField("c_custkey", T.LongType()), T.StructField("c_name", T.StringType()),
                              T.StructField("c_nationkey", T.IntegerType())]),
    "orders": T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("o_custkey", T.LongType()),
                            T.StructField("o_orderstatus", T.StringType()), T.StructField("o_orderdate", T.TimestampNTZType()),
                            T.StructField("o_orderpriority", T.StringType())]),
    "lineitem": T.StructType([T.StructField("l_orderkey", T.LongType()), T.StructField("l_linenumber", T.IntegerType()),
                              T.StructField("l_quantity", T.DoubleType()), T.StructField("l_returnflag", T.StringType()),
                              T.StructField("l_linestatus", T.StringType()), T.StructField("l_shipdate", T.TimestampNTZType())]),
    "part": T.StructType([T.StructField("p_partkey", T.LongType()), T.StructField("p_type", T.StringType())]),
    "events": T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
                            T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
                            T.StructField("value", T.DoubleType())]),
}

# View texts (FIXTURES.md), in dependency order: ``bookings`` reads ``booking_cases``.
VIEW_SQL: dict[str, str] = {
    "locations": "select cast(n_nationkey+1 as int) id, n_name name from nation",
    "departments": "select distinct cast(substr(o_orderpriority,1,1) as int) id, substr(o_orderpriority,3) name from orders union all select 6 id, 'UNUSED' name",
    "entrepreneurs": "select cast(s_suppkey+1 as int) id, s_name name, case when s_suppkey%5=0 then null else concat('Street ',cast(s_suppkey as string)) end street, lpad(cast(s_suppkey*37%100000 as string),5,'0') postal_code, n_name city from supplier join nation on n_nationkey=s_nationkey where s_suppkey%10<>9",
    "users": "select cast(c_custkey+1 as int) id, c_name username, case when c_custkey=0 then 'admin' else 'disponent' end as role, case when c_custkey%9=0 then null else cast(c_nationkey+1 as int) end location_id, case when c_custkey%4=0 then null else cast(c_custkey%4 as int) end role_id, c_custkey%7<>0 is_active, case when c_custkey%3=0 then cast(c_custkey%5+1 as int) else null end fixed_department_id from customer where c_custkey%50<>49",
    "booking_cases": """select *, case when status=4 then concat('ICSN',cast(location_id-1 as string),'-',cast(year(created_at)*10000+month(created_at)*100+day(created_at) as string),'-',lpad(cast(id as string),6,'0')) end receipt_no,
 case when status in (2,3,4) then created_by%97+1 end claimed_by, case when status in (3,4) then created_by%89+1 end submitted_by, case when status=4 then created_by%83+1 end approved_by
 from (select cast(o_orderkey+1 as int) id, cast(o_custkey%25+1 as int) location_id, case when o_orderkey%37=0 then null else cast(substr(o_orderpriority,1,1) as int) end department_id, cast(o_custkey+1 as int) created_by,
 cast(case o_orderstatus when 'F' then 4 when 'P' then 3 else o_orderkey%3 end as int) status, concat('HH',cast(o_custkey%40 as string)) license_plate,
 case when o_orderkey%13=0 then null when o_orderkey%17=0 then '' else concat('Supplier#',lpad(cast(o_custkey%10 as string),9,'0')) end entrepreneur, case when o_orderkey%5=0 then null else concat('note ',cast(o_orderkey%100 as string)) end note,
 cast(o_orderkey*7%40 as int) qty_in, cast(o_orderkey*11%30 as int) qty_out, cast(o_orderkey%4 as int) non_exchangeable_qty, case o_orderkey%4 when 0 then 'euro' when 1 then 'h1' when 2 then 'gitterbox' else null end product_type,
 case when o_orderkey%3=0 then 'A7' end employee_code, o_orderdate created_at from orders) x""",
    "bookings": """select cast(l_orderkey*8+l_linenumber as bigint) id, k.location_id, k.department_id, k.created_by user_id, case when l_returnflag='R' or (l_returnflag='N' and l_linestatus='F') then 'IN' else 'OUT' end as type, cast(l_quantity as int) quantity, k.note,
 case when k.receipt_no is not null then k.receipt_no else concat('ICSX-',cast(k.id as string)) end receipt_no, k.license_plate, k.entrepreneur, l_linenumber line_no, k.product_type, l_shipdate created_at from lineitem join booking_cases k on k.id=l_orderkey+1
 union all select cast(1000000000+event_id as bigint), cast(user_id%25+1 as int), cast(null as int), cast(user_id+1 as int), 'IN', cast(1+floor(value) as int), 'internal', cast(null as string), cast(null as string), cast(null as string), 1, 'euro', ts from events where event_type='purchase'""",
    "user_notifications": "select cast(event_id as int) id, cast(user_id+1 as int) user_id, case when event_id%23=0 then null else cast(event_id*7%20000+1 as int) end case_id, case when event_id%2=0 then 'Aviso Standort (Status 1)' else 'Aviso Abteilung (Status 3)' end title, event_id%3=0 is_read, ts created_at from events where event_type in ('view','click')",
    "roles": """select 1 id,'Standard' name,'{"bookings":{"edit":false},"masterdata":{"manage":true}}' permissions union all select 2,'Lager','{"cases":{"claim":true,"submit":true,"require_employee_code":true},"bookings":{"export":null}}' union all select 3,'Leitung','{"admin":{"full_access":true}}'""",
    "case_actions": "select cast(event_id as int) action_id, cast(user_id%120+1 as int) case_id, cast(event_id%50+1 as int) actor_id, case event_type when 'view' then 'claim' when 'click' then 'submit' when 'purchase' then 'approve' when 'signup' then 'edit' else 'cancel' end as action, ts from events where event_type<>'error' or event_id%40=0",
    "login_attempts": "select event_id attempt_id, concat('10.0.0.',cast(user_id%20 as string)) ip, event_type='purchase' ok, ts from events",
    "partner_updates": "select cast(o_orderkey as int) seq, concat('Supplier#',lpad(cast(o_custkey%15 as string),9,'0')) name, case when o_orderkey%3=0 then concat('New street ',cast(o_orderkey as string)) else null end street, cast(null as string) postal_code, case when o_orderkey%4=0 then 'Newtown' else null end city from orders where o_orderkey%20=0",
    "case_requests": "select cast(o_orderkey as int) request_id, cast(o_custkey%26 as int) location_id, cast(o_orderkey%6 as int) department_id, case o_orderkey%8 when 0 then ' hh12 ' when 1 then 'HH-12' when 2 then 'HH 12' when 3 then 'H!' when 4 then 'ab' when 5 then '' else concat('kö',cast(o_custkey as string)) end license_plate, cast(o_orderkey%5-1 as int) qty_in, cast(o_orderkey%3 as int) qty_out, case o_orderkey%7 when 0 then 'H1 ' when 1 then 'wood' when 2 then null else 'euro' end product_type, case o_orderkey%9 when 0 then 'a7' when 1 then 'abc' else null end employee_code from orders",
    # Read marks (M5): every fifth notice, a quarter of them marked by a user other than its owner.
    "read_marks": "select cast(event_id as int) notification_id, cast(user_id+1+(case when event_id%4=0 then 1 else 0 end) as int) user_id, ts + interval 1 hour read_at from events where event_type in ('view','click') and event_id%5=0",
    # Maintenance batches (W2-W9), each derived from the driver tables.
    "theme_updates": "select concat('10.0.0.',cast(user_id%20 as string)) ip_address, case event_id%5 when 0 then 'Dark ' when 1 then 'blue' when 2 then 'light' else 'dark' end theme, ts from events where event_type='view'",
    "booking_patches": "select distinct cast(l_orderkey*8+l_linenumber as bigint) id, cast(case when l_linenumber=1 then l_linenumber*3 when l_linenumber=2 then 0 end as int) quantity, case when l_linenumber=3 then ' checked ' end note, case when l_linenumber=6 then ' Supplier#000000001 ' end entrepreneur, case when l_linenumber=4 then 'hh 9' when l_linenumber=5 then 'hb77' end license_plate from lineitem where l_orderkey%7=0",
    "user_patches": "select cast(c_custkey+1 as int) id, case c_custkey%4 when 0 then 'location_id' when 1 then 'is_active,fixed_department_id' when 2 then 'role_id' else '' end present, case when c_custkey%2=0 then cast(null as int) else cast(c_nationkey+1 as int) end location_id, case when c_custkey%5=0 then null else c_custkey%3<>0 end is_active, cast(c_custkey%5 as int) role_id, cast(case when c_custkey%6=0 then 9 else c_custkey%5+1 end as int) fixed_department_id from customer where c_custkey%11=0",
    "user_requests": "select cast(c_custkey as int) request_id, case when c_custkey%7=0 then concat('x', cast(c_custkey%3 as string)) when c_custkey%7=1 then c_name else concat('new_', cast(c_custkey%500 as string)) end username, cast(c_nationkey+1 as int) location_id, cast(c_custkey%5 as int) role_id, cast(c_custkey%8 as int) fixed_department_id, case c_custkey%6 when 0 then 'bad@mail' when 1 then ' A@B.DE ' else null end email from customer",
    "partner_replacements": "select cast(s_suppkey+1 as int) id, case when s_suppkey%4=0 then ' ' when s_suppkey%4=1 then concat('Supplier#', lpad(cast((s_suppkey+7)%40 as string),9,'0')) else concat(s_name,' GmbH') end name, 'Main street 1' street, cast(null as string) postal_code, n_name city from supplier join nation on n_nationkey=s_nationkey where s_suppkey%3=0",
    "case_edits": "select cast(event_id as int) action_id, cast(user_id%300+1 as int) case_id, case when event_id%3=0 then 1 else cast(event_id%50+1 as int) end actor_id, ts, case when event_id%5=0 then cast(event_id%4+1 as int) end department_id, case event_id%7 when 0 then 'hb 12' when 1 then ' hb12 ' end license_plate, case when event_id%6=0 then ' Supplier#000000002 ' end entrepreneur, case when event_id%4=0 then 'edited' end note, case when event_id%3=0 then cast(event_id%30-2 as int) end qty_in, case when event_id%5=1 then cast(event_id%20 as int) end qty_out, case when event_id%4=1 then cast(event_id%6-1 as int) end non_exchangeable_qty, case event_id%9 when 0 then 'x9' when 1 then 'b' end employee_code, case event_id%8 when 0 then 'H1' when 1 then 'plastic' end product_type from events where event_type='signup'",
    # A whole action log over the real case ids, with payloads: every third action is on one case (the first announced
    # one), which is edited for weeks before it is claimed; the others have about five actions each, a few meet no case.
    "case_log": """select cast(event_id as int) action_id, cast(case when event_id%3=0 then (select min(id) from booking_cases where status=1) when event_id%101=0 then 900000000+event_id else floor(event_id/7)*10+1 end as int) case_id,
 cast(case when event_id%4<>1 then 1 else event_id%50+1 end as int) actor_id,
 case when event_id%3=0 then case when day(ts)>=9 and event_id%5=0 then 'claim' when day(ts)>=20 and event_id%4=1 then 'submit' when day(ts)>=27 and event_id%7=2 then 'approve' when day(ts)>=28 and event_id%11=3 then 'set_translogica' else 'edit' end
 else case event_type when 'view' then 'claim' when 'click' then 'submit' when 'purchase' then 'approve' when 'signup' then 'edit' else case event_id%5 when 0 then 'cancel' when 1 then 'archive' when 2 then 'set_translogica' else 'edit' end end end as action, ts,
 case when event_id%5=0 then cast(event_id%4+1 as int) end department_id, case event_id%7 when 0 then 'hb 12' when 1 then ' hb12 ' end license_plate, case when event_id%8=3 then ' Supplier#000000002 ' end entrepreneur, case when event_id%4=0 then 'edited' end note,
 case when event_id%4=2 then cast(event_id%30-2 as int) end qty_in, case when event_id%5=1 then cast(event_id%20 as int) end qty_out, case when event_id%5=2 or event_id%3=0 and event_id%4=1 then cast(event_id%17-1 as int) end non_exchangeable_qty,
 case event_id%13 when 0 then 'x9' when 1 then 'b' when 2 then '' end employee_code, case event_id%16 when 0 then 'H1' when 1 then 'plastic' end product_type, case when event_id%3<>1 then event_id%2=0 end translogica_transferred from events""",
    # The ledger lines as a feed in two deliveries: one line per (order, line); every fifth comes again in the second.
    "ledger_feed": """select l.id, k.location_id, k.department_id, l.type, l.quantity, k.product_type, l.created_at, d.delivery from
 (select cast(l_orderkey*8+l_linenumber as bigint) id, max(l_orderkey) l_orderkey, case when max(l_returnflag)='R' then 'IN' else 'OUT' end as type, cast(max(l_quantity) as int) quantity, min(l_shipdate) created_at from lineitem group by l_orderkey, l_linenumber) l
 join booking_cases k on k.id=l.l_orderkey+1 join (select 0 delivery union all select 1 delivery) d on (l.id%4<>0 and d.delivery=0) or (l.id%4=0 and d.delivery=1) or (l.id%5=0 and d.delivery=1)""",
    # Delete requests of every kind, by the admin and by others, some without an id, some for the actor's own row.
    "delete_requests": """select cast(event_id as int) request_id, cast(case when event_id%3=0 then 1 when event_id%3=1 then event_id%50+1 else user_id%90+1 end as int) actor_id,
 case event_type when 'view' then 'case' when 'click' then 'user' when 'purchase' then 'location' when 'signup' then case when event_id%2=0 then 'role' else 'department' end else case when event_id%17=0 then 'archive' else 'partner' end end kind,
 cast(case when event_id%29=0 then 0 when event_id%31=0 then null else case event_type when 'view' then event_id+1 when 'click' then case when event_id%5=0 then (case when event_id%3=0 then 1 when event_id%3=1 then event_id%50+1 else user_id%90+1 end) else event_id%1999+2 end when 'purchase' then event_id%60+1 when 'signup' then event_id%8+1 else event_id%200+1 end end as int) target_id from events""",
    # Role requests: blank, taken and repeated names; permissions that are no object, unknown or not boolean.
    "role_requests": """select cast(p_partkey as int) request_id, case p_partkey%6 when 0 then ' ' when 1 then 'Lager' when 2 then concat(' Team ', cast(p_partkey%40 as string), ' ') else concat('Role ', cast(p_partkey as string)) end name,
 case p_partkey%9 when 0 then '{"cases":{"claim":true,"submit":"true"},"bookings":{"export":null}}' when 1 then '[true]' when 2 then '{"cases":true,"stock":{"view":1,"overall":false}}' when 3 then '{"warehouse":{"open":true},"users":{"manage":true,"hire":false}}' when 4 then cast(null as string) when 5 then 'not json' when 6 then '{}' when 7 then '{"admin":{"full_access":[1]},"roles":{"manage":{"x":true}}}' else '{"cases":{"claim":true},"filters":{"all_locations":false}}' end permissions from part""",
    # The transfer flag the case views leave out (FIXTURES.md): booked cases with an even id.
    "booking_cases_flagged": "select *, (status=4 and id%2=0) translogica_transferred from booking_cases",
    # Department create requests: the part type as name (one exists already, most repeat), some blank.
    "department_requests": "select cast(p_partkey as int) seq, case when p_partkey%11=0 then '  ' else p_type end name from part",
    "legacy_users": "select id, username, case when id%7=0 then 'user' when id%11=0 then cast(null as string) else role end role, location_id, role_id, is_active, fixed_department_id from users",
    "location_delete_requests": "select distinct cast(user_id%30+1 as int) id from events where event_type='error'",
    "transfer_requests": "select cast(event_id as int) request_id, case when event_id%3=0 then null else cast(user_id%25+1 as int) end from_location_id, cast(event_id%25+1 as int) to_location_id, cast(floor(value) as int) qty, case when event_id%11=0 then '  ' else 'move' end note from events where event_type='signup'",
}

VIEW_NAMES = list(VIEW_SQL)


def with_prefix(*names: str) -> str:
    """``WITH`` clause defining the named views (and what they depend on) for DuckDB."""
    need = set(names)
    if need & {"bookings", "case_log", "ledger_feed", "booking_cases_flagged"}:
        need.add("booking_cases")
    parts = [f"{n} AS ({VIEW_SQL[n]})" for n in VIEW_NAMES if n in need]
    return "WITH " + ",\n".join(parts) + "\n"


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select the schema's columns in order, cast to its types (adds missing ones as NULL)."""
    have = set(df.columns)
    return df.select([
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema.fields
    ])


_TABLE_REF = re.compile(r"\b(from|join)\s+([a-z_]+)\b", re.IGNORECASE)


def _referenced(sql: str) -> list[str]:
    return sorted({m.group(2) for m in _TABLE_REF.finditer(sql)})


def _templated(sql: str) -> str:
    """View text with its table references as ``{name}`` placeholders for ``spark.sql(text, **dfs)``."""
    escaped = sql.replace("{", "{{").replace("}", "}}")
    return _TABLE_REF.sub(lambda m: f"{m.group(1)} {{{m.group(2)}}}", escaped)


class Ledger:
    """The application's tables as DataFrames, derived from one driver folder.

    Views are built on first use (only what a query touches is analysed) and
    bound to this folder's DataFrames through ``spark.sql(text, **dataframes)``,
    so no global view names are shared between ledgers.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark = spark
        self._dir = sf_dir
        self._cache: dict[str, DataFrame] = {}

    def driver(self, name: str) -> DataFrame:
        """A driver table of this folder (explicit schema, only the needed columns)."""
        key = "driver:" + name
        if key not in self._cache:
            self._cache[key] = read_driver_table(self._spark, self._dir, name)
        return self._cache[key]

    def _build(self, name: str) -> DataFrame:
        sql = VIEW_SQL[name]
        refs = _referenced(sql)
        if not refs:
            df = self._spark.sql(sql)
        else:
            dfs = {r: (self.driver(r) if r in DRIVER_SCHEMAS else self[r]) for r in refs}
            df = self._spark.sql(_templated(sql), **dfs)
        return conform(df, S.SCHEMAS[name])

    def __getitem__(self, name: str) -> DataFrame:
        if name not in VIEW_SQL:
            raise KeyError(name)
        if name not in self._cache:
            self._cache[name] = self._build(name)
        return self._cache[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in VIEW_SQL:
            raise AttributeError(name)
        return self[name]


def read_driver_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(DRIVER_SCHEMAS[name]).parquet(os.path.join(sf_dir, f"{name}.parquet"))


def load_fixture_views(spark: SparkSession, sf_dir: str) -> Ledger:
    """The ledger tables derived from the driver tables in ``sf_dir`` (built lazily)."""
    return Ledger(spark, sf_dir)


class StoredLedger(Ledger):
    """Ledger tables already stored as Parquet, one folder per table."""

    def _build(self, name: str) -> DataFrame:
        return self._spark.read.schema(S.SCHEMAS[name]).parquet(os.path.join(self._dir, name))


def load_tables(spark: SparkSession, table_dir: str) -> Ledger:
    """Read ledger tables already stored as Parquet (one folder per table)."""
    return StoredLedger(spark, table_dir)


# Storage layout of the large tables: (partition columns, sort-within-file columns).
# Location-scoped reads prune partitions; time / status ranges skip row groups by
# their min/max statistics.
LAYOUT = {
    "bookings": (["location_id"], ["created_at", "id"]),
    "booking_cases": (["location_id"], ["status", "id"]),
    "user_notifications": ([], ["user_id", "created_at"]),
    "case_actions": ([], ["case_id", "ts", "action_id"]),
}


def store_tables(ledger: Ledger, table_dir: str, names: list[str] | None = None) -> None:
    """Write ledger tables as Parquet (one folder per table) for ``load_tables``.

    Large tables follow ``LAYOUT``: rows are range-partitioned on the partition
    and order columns (one shuffle) and sorted inside each task, so a folder's
    files have tight min/max ranges and a hot location spreads over tasks.
    """
    for name in names or VIEW_NAMES:
        df = ledger[name]
        part, order = LAYOUT.get(name, ([], []))
        if part:
            df = df.repartitionByRange(*part, *order)
        if order:
            df = df.sortWithinPartitions(*part, *order)
        w = df.write.mode("overwrite")
        if part:
            w = w.partitionBy(*part)
        w.parquet(os.path.join(table_dir, name))
