"""Operators for large-scale training-data pipelines.

Nothing outside this folder imports it.  Every operator is a module with a
general interface (``DataFrame`` in, ``DataFrame`` out); the thin
``opN_*`` queries that a driver calls live in :mod:`ferrule.llm.queries`.
"""
