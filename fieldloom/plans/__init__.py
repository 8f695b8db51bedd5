"""Registered queries and their SQL."""

from . import absorbed, aggregates, audits, designs, estimates, final, grids, jobs, joins, own_samples, quality, recode, spatial, stages
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "absorbed", "aggregates", "audits", "designs", "estimates", "final", "grids", "jobs", "joins", "own_samples", "quality", "recode", "spatial", "stages"]
