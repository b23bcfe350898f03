"""Operators of a training-data pipeline: self-contained, imported by nothing else in the library."""
