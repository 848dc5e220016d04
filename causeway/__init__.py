"""causeway: evidence-carrying dependency graphs and corpus operators on Spark."""

__version__ = "0.1.0"
