"""Operators of a training-data pipeline over tables of documents and web pages.

Nothing outside this subpackage imports it.  Each operator takes a DataFrame
and column names, keeps its work on the executors and returns a DataFrame;
`queries` holds the thin registered queries over the standard tables.
"""
