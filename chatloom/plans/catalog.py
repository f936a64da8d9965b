"""All named queries."""

from . import audit, identity, ledger, live, memory, recall  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
