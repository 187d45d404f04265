"""Dependency-treebank analytics on PySpark, and operators for preparing training data."""
