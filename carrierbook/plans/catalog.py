"""Named queries: each reads the ledger tables derived from a driver folder
and runs one operator with fixed parameters.  ``ORACLE`` holds the matching
DuckDB SQL (over the same view texts) where the result is SQL-expressible.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from carrierbook.session import set_query_conf
from carrierbook.sources.fixtures import Ledger, load_fixture_views

QueryFn = Callable[[Ledger], DataFrame]

_REGISTRY: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        _REGISTRY[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return deco


def names() -> list[str]:
    _load_all()
    return list(_REGISTRY)


_LEDGERS: dict[tuple[str, int, str], Ledger] = {}


def ledger_for(spark: SparkSession, sf_dir: str) -> Ledger:
    """The ledger views of a folder, defined once per session (like tables in a catalog).

    Views are plans, not data: sharing them between queries only saves
    deriving and analysing the same definitions again.
    """
    # The id of a session object can return after a stop; that of the application does not.
    key = (spark.sparkContext.applicationId, id(spark._jsparkSession), sf_dir)
    if key not in _LEDGERS:
        _LEDGERS[key] = load_fixture_views(spark, sf_dir)
    return _LEDGERS[key]


def run(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    _load_all()
    set_query_conf(spark)
    return _REGISTRY[name](ledger_for(spark, sf_dir))


def run_on(ledger: Ledger, name: str) -> DataFrame:
    _load_all()
    return _REGISTRY[name](ledger)


def query_callables() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load_all()
    return {n: (lambda spark, sf_dir, _n=n: run(spark, sf_dir, _n)) for n in _REGISTRY}


def oracle_sql() -> dict[str, str]:
    _load_all()
    return dict(ORACLE)


def _load_all() -> None:
    # Importing the query modules fills the registry.
    from carrierbook.plans import queries_access, queries_admin, queries_core, queries_lifecycle, queries_lists, queries_live, queries_maintain, queries_misc, queries_notify, queries_posting  # noqa: F401
