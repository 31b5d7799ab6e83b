"""Training-data operators: filters, de-duplication, packing, tokenizing, media columns.

Nothing else in the library imports this package. ``registry`` lists its queries
and their SQL twins.
"""
