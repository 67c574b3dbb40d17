"""Every query of the library by name, with its check SQL."""

from tickloom.catalog import accounts, bars, indicators, research, streams  # noqa: F401  (they register)
from tickloom.catalog.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
