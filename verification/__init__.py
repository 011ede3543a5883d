"""Registered queries over the given tables and the SQL that must agree with them."""

from verification import q_boundary, q_changes, q_indicators, q_screens, q_shaped  # noqa: F401
from verification.registry import QUERIES  # noqa: F401
