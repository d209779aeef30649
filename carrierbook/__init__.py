"""carrierbook — load-carrier (pallet) ledger analytics on Spark.

Every operator is a function from DataFrames to DataFrames built on public
Spark SQL / Structured Streaming functions.  Sub-packages:

* ``sources``   – table schemas, driver-table fixtures, readers and export sinks
* ``functions`` – column expressions (normalisation rules, search, receipt numbers)
* ``operators`` – the ledger, case, notification, maintenance and access jobs
* ``plans``     – named, parameterised queries and their DuckDB oracle SQL
* ``streaming`` – live stock, case state and change feeds
"""

from carrierbook.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
