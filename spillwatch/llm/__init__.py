"""Operators of a training-data pipeline, with their queries in ``queries``. Nothing else in the package imports this folder."""
