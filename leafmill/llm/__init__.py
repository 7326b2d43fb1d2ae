"""Training-data operators: ten methods over ``documents``-shaped tables.

Nothing outside this subpackage imports it.
"""
