"""All registered queries of the engine."""

from . import compose, composites, payloads, records, scheduling, streams  # noqa: F401
