"""graphloom: graph analytics and record linkage as declarative Spark plans."""

__version__ = "0.1.0"
