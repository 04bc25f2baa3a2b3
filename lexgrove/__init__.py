"""Frame-semantics feature and evaluation engine on Spark."""
