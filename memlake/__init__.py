"""memlake: memory analytics on Spark (see README.md)."""

__version__ = "0.1.0"
