"""Operators of a training-data pipeline, each a Spark job over the text tables.

Nothing else in the library imports this package; it imports only general helpers from the library.
"""
