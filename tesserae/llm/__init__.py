"""Training-data operators: media columns, token files, line and near dedup, mixing, packing and the like.

Nothing else in the library imports this subpackage; it can be deleted and the rest still works.
"""
