"""Agent-run analytics on Spark: steps in, failing step and root cause out."""

from stepscope.config import Settings
from stepscope.session import cut, tune

__all__ = ["Settings", "cut", "tune"]
