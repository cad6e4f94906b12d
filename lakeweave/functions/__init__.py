"""Function registries, one a kind. Names are upper case; register_*() extends them."""

from .aggregate import AGGREGATES, register_aggregate
from .scalar import SCALARS, register_scalar
from .table import TABLES, register_table
from .window import WINDOWS, register_window

__all__ = ["AGGREGATES", "SCALARS", "TABLES", "WINDOWS", "register_aggregate", "register_scalar", "register_table", "register_window"]
