"""Registered queries: each operator on the role tables, with its SQL twin where SQL can say it."""

from fleetcast.queries.base import oracles, registered

__all__ = ["oracles", "registered"]
