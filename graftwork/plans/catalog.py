"""All registered queries."""

from graftwork.plans import chatting, evaluation, merging, planning, reporting, selection, storage  # noqa: F401
from graftwork.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
