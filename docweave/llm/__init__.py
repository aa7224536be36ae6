"""Training-data operators over a ``documents`` table.

Each module holds one operator; ``queries`` binds them to the tables and gives
the SQL to check them by.  Nothing outside this package imports it.
"""
