"""weftcore: weighted-point summaries (coresets) on Spark DataFrames.

Points are rows ``(pid BIGINT, features ARRAY<DOUBLE>, weight DOUBLE)``.
Samplers reduce keyed groups of points to small weighted samples, the
merge-and-reduce tree composes them, models are fitted with Spark ML on
the samples, and evaluation scores saved models against growing prefixes
of the data.  Streaming keeps the tree in a versioned table between
micro-batches.
"""

from weftcore.session import build_session, ensure_checkpoint_dir, scratch_path

__all__ = ["build_session", "ensure_checkpoint_dir", "scratch_path"]
