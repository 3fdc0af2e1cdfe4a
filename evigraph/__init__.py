"""Evidence-graph analytics on Spark."""
