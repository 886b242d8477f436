"""Applying fitted state to streams.

The reference has no streaming operators, so nothing here adds a new one.
Fitted feature state is ordinary DataFrames (lookup tables, literal scalars),
and the same ``apply`` code paths work on a streaming DataFrame as
stream-static joins; see ``apply.py``.
"""
