"""Port-level traffic profiling as Spark DataFrame jobs."""

from harborwatch.schema import Params

__all__ = ["Params"]
