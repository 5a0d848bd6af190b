"""All registered queries of the library and the SQL that gives the same rows."""

from __future__ import annotations

from importlib import import_module

from visitlens.plans.registry import ORACLE_SQL, QUERIES

#: The modules whose import registers queries.
PLANS = ["sessions", "relational", "intervals", "profiles", "digest", "geometry", "vectors", "evaluation", "ledger", "identity", "records", "scores", "streams", "rules", "storage"]

for _name in PLANS:
    import_module(f"visitlens.plans.{_name}")

__all__ = ["ORACLE_SQL", "QUERIES"]
