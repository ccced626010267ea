"""Operators of a training-data pipeline over ``documents``, ``pages``, ``labels`` and ``conversations``.

Nothing else in the library imports this subpackage.
"""
