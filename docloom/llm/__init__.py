"""Operators of a training-data pipeline. Nothing else in docloom imports this subpackage."""
