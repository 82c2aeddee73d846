"""All registered queries and their SQL twins."""

from panelspark.queries import tables, columns, windows, samples, statistics, learning  # noqa: F401
from panelspark.queries.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
