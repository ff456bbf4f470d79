"""Operators for training-data pipelines over ``documents``-like tables.

Nothing else in weftcore imports this subpackage.  Each module holds one
operator with a general interface; :mod:`weftcore.llm.queries` registers the
thin queries over the given tables.
"""
