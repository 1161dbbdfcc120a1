"""All registered queries; importing the modules fills the registry."""

from stepscope.catalog import judged, reshape, steps, texts  # noqa: F401
from stepscope.catalog.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
