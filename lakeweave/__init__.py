"""lakeweave: a compact SQL dialect and its operators, lowered to Spark DataFrames."""

from .engine import Engine
from .errors import QueryError

__all__ = ["Engine", "QueryError"]
