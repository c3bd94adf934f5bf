"""Operators of a training-data pipeline over document tables.

Nothing else in the library imports this subpackage.  Every operator selects
the columns that it needs by name first, so further columns of its input (also
ones named like its results) never clash.  Null texts count as empty.
"""
