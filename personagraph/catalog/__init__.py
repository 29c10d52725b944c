"""All registered queries. Importing a module registers what it holds."""

from . import directory, graph, landed, soundness, streams, texts  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
