"""Queries over the tables, registered by name with the SQL that gives the same rows."""

from histlake.plans import events, growth, records, retrieval, streams, upkeep  # noqa: F401
