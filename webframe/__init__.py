"""webframe: web-snapshot processing as Spark DataFrame jobs."""

from webframe.options import MirrorOptions

__all__ = ["MirrorOptions"]
