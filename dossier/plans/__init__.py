"""The registered queries; importing a module of queries registers them."""

from dossier.plans import library, more, relational, search, surface, texts  # noqa: F401
from dossier.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
