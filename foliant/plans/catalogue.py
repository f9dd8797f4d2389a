"""Every query by name with the SQL it is held against."""

from __future__ import annotations

from foliant.plans import bindings, second_looks, structure  # the others register their queries beside those of bindings

__all__ = ["QUERIES", "ORACLE_SQL", "second_looks", "structure"]

QUERIES = dict(bindings.QUERIES)
ORACLE_SQL = dict(bindings.ORACLE_SQL)
