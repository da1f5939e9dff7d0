"""All queries over the driver's tables, and the SQL of those that SQL can express."""

from folioq.plans import changes, documents, events, language, lists, pages, shelf, stores  # noqa: F401  they register themselves
from folioq.plans.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
