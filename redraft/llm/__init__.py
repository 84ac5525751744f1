"""Operators for preparing training text at scale.

Nothing outside this folder imports it.  Every operator takes a DataFrame and
the names of its id and text columns and returns a DataFrame of the id and its
results; other columns are left behind, so their names cannot clash.
"""
