"""Operators of a training-data pipeline. Nothing else in termloom imports this subpackage."""
