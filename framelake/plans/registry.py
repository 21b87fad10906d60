"""Queries and their SQL by name, gathered from the plan modules."""

from . import atom_queries, spectrum_queries, stack_queries

QUERIES: dict = {**stack_queries.QUERIES, **atom_queries.QUERIES, **spectrum_queries.QUERIES}
ORACLES: dict = {**stack_queries.ORACLES, **atom_queries.ORACLES, **spectrum_queries.ORACLES}
