"""A Spark-native analytical SQL engine.

``query(spark, catalog, text)`` turns one SELECT statement into a DataFrame; Catalyst and
Tungsten plan and run it.
"""

from .errors import QueryError
from .plans.lower import query
from .session import session
from .sources.catalog import Catalog

__all__ = ["Catalog", "QueryError", "query", "session"]
