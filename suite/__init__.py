"""Queries over the driver tables, each with the SQL that checks it."""

from . import q_checks, q_gstr2b, q_ops, q_plans, q_returns, q_sales, q_state, q_streams, q_text
from .registry import ORACLES, QUERIES

q_streams.share_checks(ORACLES)

__all__ = ["ORACLES", "QUERIES"]
