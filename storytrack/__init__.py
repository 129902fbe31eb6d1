"""storytrack — a PySpark engine for tracking how posts gain attention over time.

Every operator is a function from DataFrames to a DataFrame. Nothing reads the
wall clock: each time-dependent job takes an explicit ``as_of`` timestamp.
"""

from storytrack.session import AS_OF, build_session, checkpoint_dir

__all__ = ["AS_OF", "build_session", "checkpoint_dir"]
