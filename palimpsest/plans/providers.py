"""Model providers by name: functions over pandas series, used as vectorised functions."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Text = Callable[[pd.Series], pd.Series]

_registry: dict[tuple[str, str], Callable] = {}


def register(kind: str, name: str, function: Callable) -> None:
    """``kind``: generate, embed or rerank."""
    _registry[kind, name] = function


def provider(kind: str, name: str) -> Callable:
    if (kind, name) not in _registry:
        raise KeyError(f"no {kind} provider {name!r}; known: {sorted(n for k, n in _registry if k == kind)}")
    return _registry[kind, name]


def generate(column: Column, name: str = "echo") -> Column:
    return F.pandas_udf(_typed(provider("generate", name), 1), "string")(column)


def embed(column: Column, name: str) -> Column:
    return F.pandas_udf(_typed(provider("embed", name), 1), "array<float>")(column)


def rerank(query: Column, content: Column, name: str) -> Column:
    return F.pandas_udf(_typed(provider("rerank", name), 2), "double")(query, content)


def fallback(*functions: Callable) -> Callable:
    """The first function that does not raise answers a batch."""

    def call(*series: pd.Series) -> pd.Series:
        last: Exception | None = None
        for function in functions:
            try:
                return function(*series)
            except Exception as error:
                last = error
        raise RuntimeError("every provider failed") from last

    return call


def _typed(function: Callable, arguments: int) -> Callable:
    if arguments == 1:

        def one(a: pd.Series) -> pd.Series:
            return function(a)

        return one

    def two(a: pd.Series, b: pd.Series) -> pd.Series:
        return function(a, b)

    return two


register("generate", "echo", lambda s: s)
