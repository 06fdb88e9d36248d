"""Operators for large-scale training-data pipelines.

Nothing outside this subpackage imports it; ``corpus_pipeline.py`` and the guarded block of
``__spark_entry__.py`` are its only users.  Every operator is a function from DataFrames to a
DataFrame; the thin, contract-shaped queries live in :mod:`factloom.llm.queries`.
"""
