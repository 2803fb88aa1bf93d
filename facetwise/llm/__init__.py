"""Training-data operators: thirteen whole-corpus operators and their queries.

Nothing else in the library imports this subpackage.
"""
