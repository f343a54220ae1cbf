"""The library's queries over the driver's tables, each beside its SQL."""

from __future__ import annotations

from tessera.plans import models, ranking, tiling

_MODULES = (tiling, ranking, models)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}


def flagship(spark, sf_dir):
    """The ten texts nearest to each benchmark item."""
    return ranking.rank_texts(spark, sf_dir)
