"""foldwise: a Spark-native toolkit for leakage-safe tabular feature
preparation, cross-validation, scoring and blending.

Every operator is a lazy DataFrame transformation; fitted statistics are small
DataFrames applied by (size-checked) broadcast joins, and everything that needs
a global row order uses distributed position numbering instead of a
single-partition window.
"""

__all__ = ["session"]
