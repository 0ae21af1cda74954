"""Imports every query module so that the registry is complete."""

from quarry.plans import registry
from quarry.plans import (chunk_queries, compose_queries, html_queries, io_queries, relational_queries, search_queries,  # noqa: F401
                          stream_queries, text_queries)


def queries():
    return dict(registry.QUERIES)


def oracle_sql():
    return dict(registry.ORACLES)
