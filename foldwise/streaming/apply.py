"""Score a stream of new rows with state fitted in batch.

Order-dependent ops (lag / rolling mean) need a global row order, which a
stream does not have; they are refused.  Everything else (elementwise
expressions, count / title lookups, full-train deferred encodings, median
fill and ordinal codes) is a projection or a stream-static left join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from foldwise.operators.features import FittedFeatures
from foldwise.operators.infold import Deferred, full_fit_encode
from foldwise.operators.matrix import FittedMatrix


def apply_to_stream(stream: DataFrame, features: FittedFeatures, matrix: FittedMatrix | None = None,
                    deferred: Sequence[Deferred] = (), train: DataFrame | None = None, target: str | None = None,
                    keep: Sequence[str] = ()) -> DataFrame:
    if not stream.isStreaming:
        raise ValueError("expected a streaming DataFrame")
    if any(op.operation in ("lag", "rolling_mean") for op in features.ops):
        raise ValueError("lag / rolling_mean need a global row order and cannot score a stream")
    out = features.apply(stream)
    if deferred:
        if train is None or target is None:
            raise ValueError("deferred encodings need the training frame and target")
        out = full_fit_encode(train, out, list(deferred), target)
    if matrix is not None:
        extra = [op.output_name for op in deferred]
        out = matrix.apply(out, keep=[*keep, *extra])
    return out
