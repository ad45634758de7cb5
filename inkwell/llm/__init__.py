"""Operators for large training-data pipelines. Nothing else in the package imports this subpackage."""
