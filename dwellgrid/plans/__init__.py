"""Registered queries over the bound test tables."""

from importlib import import_module

AREAS = (
    "funnel_queries",
    "quality_queries",
    "report_queries",
    "movement_queries",
    "pos_queries",
    "identity_queries",
    "anomaly_queries",
    "source_queries",
    "insight_queries",
    "stream_queries",
)


def load_registry():
    from dwellgrid.plans.registry import ORACLES, QUERIES

    for area in AREAS:
        import_module(f"dwellgrid.plans.{area}")
    return QUERIES, ORACLES
