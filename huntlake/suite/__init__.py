"""Every operator as a runnable query over the given tables, with the SQL that says what it
must return."""

from huntlake.suite.base import ORACLES, QUERIES
from huntlake.suite import detection, hunting, ingest, live, privacy, quality, upkeep  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]
