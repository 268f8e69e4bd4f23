"""Operators that prepare text for language-model training.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames; intermediate tables go to the folder in ``spark.checkpoint.dir``.
"""
