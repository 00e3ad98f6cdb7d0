"""All registered queries with their SQL statements."""

from __future__ import annotations

from workloads import question_queries, source_queries, table_queries, verdict_queries

MODULES = [question_queries, table_queries, verdict_queries, source_queries]
ENTRIES = {name: entry for module in MODULES for name, entry in module.ENTRIES.items()}
