"""Training-data operators.

Every module holds one operator with its own interface; ``queries`` has the
registered ``opN_<name>`` queries and their DuckDB SQL.  Nothing else in the
library imports this subpackage.
"""
