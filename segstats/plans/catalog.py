"""All queries; importing the modules registers them."""

from segstats.plans import dataset, evaluation, geometry, rasters  # noqa: F401
from segstats.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
