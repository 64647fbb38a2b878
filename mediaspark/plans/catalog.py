"""All registered queries; importing a plan module registers its queries."""

from . import basics, copies, ingest, ops, results, search, streams  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401

FLAGSHIP = "hybrid_search"
