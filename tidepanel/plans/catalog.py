"""All named queries; importing the plan modules declares them."""

from tidepanel.plans import comparison, components, graphs, ingest, learning, panels, quality, scoring, topology  # noqa: F401
from tidepanel.plans.registry import ORACLE, QUERIES  # noqa: F401
