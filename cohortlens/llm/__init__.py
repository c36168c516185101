"""Operators of a training-data pipeline (documents and web pages).

One module per operator; ``queries`` holds the registered queries and their SQL.
Nothing else in the library imports this subpackage.
"""
