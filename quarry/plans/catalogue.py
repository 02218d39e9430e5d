"""All queries of the engine's own operators by name, with their SQL."""

from quarry.plans import aggregates, curation, files, filters, graph, joins, patterns, scalars, series, streams, texts, training  # noqa: F401
from quarry.plans.registry import QUERIES, SQL  # noqa: F401
