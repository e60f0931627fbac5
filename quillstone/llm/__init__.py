"""Operators for preparing training data at scale.

Nothing outside this subpackage imports it; the query registry adds its
queries only when it can be imported.
"""
