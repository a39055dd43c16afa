"""Named queries over the test tables, each with the SQL that says the same."""

from .oracles import SQL
from .queries import QUERIES

__all__ = ["QUERIES", "SQL"]
