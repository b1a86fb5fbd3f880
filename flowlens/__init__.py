"""flowlens: leak-aware analytics over network-flow tables, written as Spark DataFrame jobs."""

__version__ = "0.1.0"
