"""Registered queries on the given tables."""

from importlib import import_module

MODULES = (
    "draw_queries", "prep_queries", "flow_queries", "mapping_queries", "metric_queries", "cascade_queries",
    "model_queries",
)


def load() -> None:
    for name in MODULES:
        import_module(f"{__name__}.{name}")
