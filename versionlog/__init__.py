"""versionlog: a multi-version key/value engine whose reads are Spark DataFrames."""

__version__ = "0.1.0"
