"""Operators of a training-data pipeline: tokens, near copies, mixing, storage, filtering, search.

Nothing outside this subpackage imports it.  Each module holds one operator with a
general interface; ``queries.py`` binds the operators to the synthetic tables.
"""
