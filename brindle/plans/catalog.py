"""All registered queries."""

from . import arrays, events, metrics, relational, tables, text  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
