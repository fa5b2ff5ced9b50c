"""Operators of a training-data pipeline, one module each.

Nothing else in the package imports this subpackage.  Queries and their SQL
are in ``queries``; the composed pipeline is ``corpus_pipeline.py`` at the
repository's top.
"""
