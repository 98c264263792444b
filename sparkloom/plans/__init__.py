"""The registered queries, by name in ``registry.QUERIES``."""

from . import files, queries, records, scoring, states, streams  # noqa: F401
