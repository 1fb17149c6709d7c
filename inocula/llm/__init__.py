"""Operators of a training-data pipeline over a table of documents.

One module per operator, plus ``queries`` (the registered ``opN_*`` runs and
their DuckDB SQL).  Nothing else in the library imports this package.
"""
