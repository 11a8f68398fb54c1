"""All registered queries, one module per area."""

from importlib import import_module

AREAS = ("survival", "scalars", "sequences", "draws", "population", "aggregates", "comparison", "compare", "transitions", "evidence",
         "streams")


def load_catalog():
    from .registry import ORACLES, PLANS, runner

    for area in AREAS:
        import_module(f"{__name__}.{area}")
    return {name: runner(plan) for name, plan in PLANS.items()}, dict(ORACLES)
