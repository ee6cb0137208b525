"""Training-data operators: ten corpus operators and the queries over them.

Nothing else in the library imports this package; it may be removed as a whole.
"""
