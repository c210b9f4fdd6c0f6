"""strandlog: durable, ordered event logs as Spark DataFrames."""

__version__ = "0.2.0"
