"""transitio: longitudinal state-transition analytics as Spark DataFrame plans.

Every public operator is a function ``(DataFrame, params) -> DataFrame`` built from
Spark SQL expressions, windows and equi-joins, so Catalyst sees one plan per output.
"""

from transitio.session import build_session, scratch_dir

__all__ = ["build_session", "scratch_dir"]
