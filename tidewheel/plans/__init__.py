"""The queries, each next to the SQL that gives the same rows."""

from tidewheel.plans import aggregates, columns, joins, ordered, sets, streams, timewindows  # noqa: F401
from tidewheel.plans.registry import ORACLES, QUERIES  # noqa: F401
