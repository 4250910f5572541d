"""Training-data operators: deduplication, filtering, extraction, search, scoring, mixing and packing.

Nothing outside this subpackage imports it.  ``queries()`` and ``oracle_sql()`` in
:mod:`quarrylens.llm.catalog` are what ``__spark_entry__`` registers.
"""
