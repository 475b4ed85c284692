"""The registered queries of the engine's operators and their SQL."""

from lamina.plans import imaging, inference, joins, metrics, records, series, sessions, spatial, workflow  # noqa: F401
from lamina.plans.fixtures import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
