"""The registered queries, one module per area."""

from importlib import import_module

AREAS = ["voxels", "morphology", "scoring", "timeseries", "splits", "hotspots", "models", "storage"]


def load():
    from .registry import ORACLES, QUERIES

    for area in AREAS:
        import_module(f"{__name__}.{area}")
    return dict(QUERIES), dict(ORACLES)
