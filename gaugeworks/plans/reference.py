"""All reference queries: importing the modules registers them."""

from . import captures, claims, decoding, folders, ledgers, mechanisms, queries, scenarios, sweeps, trials, vectors, verdicts  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
