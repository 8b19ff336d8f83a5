"""Registered queries; importing the plan modules fills the registry."""

from . import advantages, allocation, curation, diagnostics, evaluation, replay, retrieval, sources, streams, trees  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
