"""Evidence-graph analytics on PySpark."""
