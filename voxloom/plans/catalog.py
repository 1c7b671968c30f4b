"""All queries: importing their modules registers them."""

from voxloom.plans import files, grids, lines, objects, spatial, whole  # noqa: F401
from voxloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
