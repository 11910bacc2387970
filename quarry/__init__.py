"""Evidence-retrieval analytics on Spark."""
