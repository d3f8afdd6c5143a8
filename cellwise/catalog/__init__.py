"""All registered queries with their oracle text."""

from . import algebra, learning, raster, records, spatial, statistics  # noqa: F401
from .base import ORACLES, QUERIES  # noqa: F401
