"""Operators for building training corpora: deduplication, language, licences, tokens, mixing, archives, URL filters, packing,
divergence of sources, fill-in-the-middle.

Nothing outside this package imports it. Every operator takes DataFrames and returns a DataFrame; narrow
intermediates are written to the folder named in ``spark.checkpoint.dir``, so a lost executor costs a task, not a run.
"""
