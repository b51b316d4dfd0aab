"""The registered queries, each with its independent SQL formulation."""

from . import aggregates, documents, filters, functions, jobs, joins, ordered, sources, streams  # noqa: F401
from .registry import REGISTRY  # noqa: F401
