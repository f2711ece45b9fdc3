"""Registered queries with their check in standard SQL."""

from themescope.catalog import (  # noqa: F401
    attempts, evaluation, preparation, reports, sampling, storage, topics, vectors,
)
from themescope.catalog.registry import ORACLES, QUERIES  # noqa: F401
