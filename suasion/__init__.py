"""suasion — persuasion-text feature and classification jobs on Spark.

Every public operator is a function ``f(df, *, column names...) -> DataFrame``
built from DataFrame / SQL expressions, so Catalyst can prune, push down and
plan it; Python runs only inside Arrow-batched pandas functions where noted.
"""

from suasion.session import get_session, scratch_path

__all__ = ["get_session", "scratch_path"]
