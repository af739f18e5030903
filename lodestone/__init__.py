"""Evidence analytics on Spark: text, retrieval, judging and evaluation as DataFrame operators."""
