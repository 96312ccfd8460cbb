"""Training-data operators: ten corpus operators, one module each.

Nothing outside this package imports it.
"""
