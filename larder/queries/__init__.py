"""Named queries over the stored tables, each with the SQL text an independent engine can check it with."""

from larder.queries import demand, documents, forecasting, landing, mapping, menus, ordering, recommending, streams  # noqa: F401
from larder.queries.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
