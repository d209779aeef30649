"""Operators of a training-data pipeline over document and page tables.

Each module holds one operator with its own general interface; ``queries`` holds the thin
registered queries.  Nothing else in the library imports this subpackage.

Conventions shared by all operators:

* a null text counts as the empty text; a null id stays null and takes no part in links;
* only the named columns are read, so further columns (also ones named like an output) do no harm;
* an empty table gives an empty result with the same columns;
* every row of the input is answered, rows that repeat included, unless a docstring says otherwise.
"""
