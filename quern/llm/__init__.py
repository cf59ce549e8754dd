"""Operators for training-data pipelines. Nothing else in quern imports this subpackage."""
