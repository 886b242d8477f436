"""Feature-op records and the operator registry."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass, field
from typing import Any

# Fixed values that must equal the reference: the 19 registered operations
# with their input arity, kind (immediate = fit on train, apply to train and
# test; deferred = fit inside each CV fold) and whether they need row order.
REGISTRY: dict[str, tuple[int, str, bool]] = {
    "log_transform": (1, "immediate", False),
    "sqrt_transform": (1, "immediate", False),
    "interaction_multiply": (2, "immediate", False),
    "interaction_ratio": (2, "immediate", False),
    "polynomial_degree2": (1, "immediate", False),
    "bin_equal_width": (1, "immediate", False),
    "bin_equal_freq": (1, "immediate", False),
    "group_mean_encode": (2, "deferred", False),
    "group_std_encode": (2, "deferred", False),
    "target_encode": (1, "deferred", False),
    "tfidf_svd": (1, "immediate", False),
    "datetime_parts": (1, "immediate", False),
    "lag": (1, "immediate", True),
    "rolling_mean": (1, "immediate", True),
    "count_encoding": (1, "immediate", False),
    "extract_title": (1, "immediate", False),
    "family_size": (2, "immediate", False),
    "is_alone": (2, "immediate", False),
    "cabin_deck": (1, "immediate", False),
}
# Ops refused on identity-like (near-unique) columns.
IDENTITY_UNSAFE_OPS = ("tfidf_svd",)

# Ops that compute with their input: refused on texts, dates and nested values.
NUMERIC_OPS = ("log_transform", "sqrt_transform", "interaction_multiply", "interaction_ratio", "polynomial_degree2",
               "bin_equal_width", "bin_equal_freq", "rolling_mean", "family_size", "is_alone")



@dataclass(frozen=True)
class Plugin:
    """A user's op.  ``fit(train, op)`` returns its statistics as a table: one
    row, or, with ``keyed``, a row a value of the op's first column, in its
    first column.  ``apply(op, stats)`` gets the statistics as Columns by
    name (those of a row's own key; NULL for an unseen one) and returns a
    Column, or a dict of Columns by output name."""

    name: str
    fit: Callable
    apply: Callable
    keyed: bool


PLUGINS: dict[str, Plugin] = {}


def register(name: str, arity: int, fit: Callable | None, apply: Callable, *, keyed: bool = False) -> None:
    """Add an immediate op to the registry; plans, validation, fitting and
    streams treat it like the built-in ones.  ``fit`` may be None for an op
    without statistics.  Built-in ops cannot be replaced; a registered one can."""
    if name in REGISTRY and name not in PLUGINS:
        raise PlanError(f"{name!r} is a built-in operation")
    if arity < 1:
        raise PlanError("an operation needs a column")
    if keyed and fit is None:
        raise PlanError("a keyed operation needs a fit")
    REGISTRY[name] = (arity, "immediate", False)
    PLUGINS[name] = Plugin(name, fit, apply, keyed)


def unregister(name: str) -> None:
    if name not in PLUGINS:
        raise PlanError(f"{name!r} is not a registered operation")
    del REGISTRY[name], PLUGINS[name]


@contextmanager
def registered(name: str, arity: int, fit: Callable | None, apply: Callable, *, keyed: bool = False):
    """``register`` for the length of a block; what was compiled in it stays usable."""
    register(name, arity, fit, apply, keyed=keyed)
    try:
        yield
    finally:
        unregister(name)


DEFERRED = tuple(k for k, v in REGISTRY.items() if v[1] == "deferred")
ORDERED = tuple(k for k, v in REGISTRY.items() if v[2])

class PlanError(ValueError):
    """An op is routed to the wrong executor or lacks what it needs."""


@dataclass(frozen=True)
class FeatureOp:
    operation: str
    columns: tuple[str, ...]
    output_name: str
    params: dict[str, Any] = field(default_factory=dict, hash=False, compare=False)
    rationale: str = ""

    @staticmethod
    def of(operation: str, columns, output_name: str, **params) -> "FeatureOp":
        cols = (columns,) if isinstance(columns, str) else tuple(columns)
        return FeatureOp(operation, cols, output_name, dict(params))

    @property
    def kind(self) -> str:
        return REGISTRY[self.operation][1]

    def param(self, name: str, default):
        v = self.params.get(name, default)
        return type(default)(v) if v is not None else default
