"""Every operator as a query on the benchmark tables, with an independent SQL statement of its result."""

from catalog.base import ORACLES, QUERIES
from catalog import cleansing, evaluation, features, labels, patterns, sources, timeline  # noqa: F401  (register)

__all__ = ["ORACLES", "QUERIES"]
