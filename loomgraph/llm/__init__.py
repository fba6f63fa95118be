"""Operators for large-scale training-data pipelines.

Self-contained: nothing outside this subpackage imports it.  ``queries.py``
holds the registered queries (``opN_<name>``) and ``oracles.py`` their SQL.
"""
