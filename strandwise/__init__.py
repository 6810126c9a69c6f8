"""Score-associated motif discovery and corpus data processing as Spark jobs."""

__version__ = "0.1.0"
