"""Example queries over the driver tables, one per operator."""


def load():
    from . import sources, scalars, joins, aggregates, graphs, geometries, buildings, networks, heats  # noqa: F401
    from .base import ORACLES, QUERIES

    return QUERIES, ORACLES
