"""Registered workloads: each is a Spark query over the driver's tables plus
(where SQL can express it) an independent SQL statement computing the same
result, used as the correctness oracle."""

from __future__ import annotations

from foldwise.workloads.common import REGISTRY, Workload  # noqa: F401
from foldwise.workloads import features as _features  # noqa: F401
from foldwise.workloads import folds as _folds  # noqa: F401
from foldwise.workloads import infold as _infold  # noqa: F401
from foldwise.workloads import io as _io  # noqa: F401
from foldwise.workloads import linear as _linear  # noqa: F401
from foldwise.workloads import plans as _plans  # noqa: F401
from foldwise.workloads import profile as _profile  # noqa: F401
from foldwise.workloads import scoring as _scoring  # noqa: F401
from foldwise.workloads import search as _search  # noqa: F401
from foldwise.workloads import text as _text  # noqa: F401
from foldwise.workloads import training as _training  # noqa: F401


def queries():
    return {name: w.fn for name, w in REGISTRY.items()}


def oracle_sql():
    return {name: w.sql for name, w in REGISTRY.items() if w.sql}
