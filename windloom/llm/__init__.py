"""Training-data operators: token counts, near-duplicates, classifiers, sharding, media, URL rules and packing.

Nothing outside this subpackage imports it.  ``queries()`` and ``oracle_sql()`` are what ``__spark_entry__`` registers.
"""

from windloom.llm.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
