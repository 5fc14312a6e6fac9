"""ledgerline — ledgered CSV ingestion and analytics on PySpark.

Every operator takes and returns DataFrames; the heavy lifting is done by
Catalyst/Tungsten (built-in expressions, aggregates, windows, joins).
"""

from ledgerline.session import build_session, scratch_dir  # noqa: F401

__all__ = ["build_session", "scratch_dir"]
