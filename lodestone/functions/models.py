"""Hooks for models that aren't part of the library: each turns a function over batches into a column."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.sources.readers import ModelNotAvailable


def _hook(load: Callable | None, kind: str, what: str, n: int):
    if load is None:
        raise ModelNotAvailable(f"{what} needs a model: pass load(), which runs once in each worker and returns a function over batches")

    if n == 1:

        @F.pandas_udf(kind)
        def one(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load()
            for batch in batches:
                yield pd.Series(list(model(batch.tolist())))

        return one

    @F.pandas_udf(kind)
    def two(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for a, b in batches:
            yield pd.Series(list(model(a.tolist(), b.tolist())))

    return two


def encode(text: Column, load: Callable | None = None) -> Column:
    """A vector for each text."""
    return _hook(load, "array<float>", "encode", 1)(text)


def cross_encode(query: Column, text: Column, load: Callable | None = None) -> Column:
    """A score for each pair of texts."""
    return _hook(load, "double", "cross_encode", 2)(query, text)


def generate(prompt: Column, load: Callable | None = None) -> Column:
    """A continuation of each prompt."""
    return _hook(load, "string", "generate", 1)(prompt)
