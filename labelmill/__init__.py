"""Multi-label document tagging and evaluation as PySpark DataFrame operators."""
