"""Query registry: ``key -> (spark builder, oracle SQL or None)``.

Keys are the lower-cased operator ids of SURVEY §2.  Every builder takes
``(spark, sf_dir)`` and reads the given tables (or data Spark derives from
them); every float column is rounded with ``r6`` on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

REGISTRY: dict[str, tuple[Callable, str | None]] = {}


def register(key: str, sql: str | None = None):
    def deco(fn):
        if key in REGISTRY:
            raise KeyError(f"duplicate query {key}")
        REGISTRY[key] = (fn, sql)
        return fn
    return deco


def load_all() -> dict[str, tuple[Callable, str | None]]:
    # importing the modules fills REGISTRY
    from suasion.plans import (q_sources, q_shape, q_relational, q_splits,  # noqa: F401
                               q_features, q_text, q_model, q_grid, q_sparse)
    return REGISTRY
