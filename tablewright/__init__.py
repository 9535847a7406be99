"""Table profiling, feature preparation, training and evaluation as Spark jobs."""

from tablewright.session import build_session, scratch_dir
from tablewright.splits import Splits

__all__ = ["Splits", "build_session", "scratch_dir"]
__version__ = "0.1.0"
