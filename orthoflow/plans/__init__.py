"""Named queries over the driver's tables, each with its SQL."""

from __future__ import annotations

from orthoflow.plans import composed, correction, files, gridded, iterated, masked, matched, measured, metadata, pairs, projected, shapes, stacks, windowed  # noqa: F401
from orthoflow.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
