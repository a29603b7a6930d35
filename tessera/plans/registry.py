"""User transforms: functions of a Column that pipes may call by name."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .preset import PresetError

_TRANSFORMS: dict[str, Callable] = {}
BUILT_IN = {"cast", "scale", "arithmetic", "lookup", "regex", "split"}


def register_transform(name: str, kind: T.DataType | None = None):
    """Register `fn(value: Column, args, options) -> Column` as a pipe step; null results count as soft failures."""

    def add(fn: Callable[[Column, list, dict], Column]):
        if name in _TRANSFORMS or name in BUILT_IN:
            raise ValueError(f"there is a transform {name!r} already")
        _TRANSFORMS[name] = lambda value, args, options: (fn(value, args, options), kind or T.StringType())
        return fn

    return add


def register_python_transform(name: str, kind: T.DataType | None = None):
    """Register `fn(value, args, options)` on plain values, run in Arrow batches; an exception makes the value null."""

    def add(fn: Callable):
        def column(value: Column, args: list, options: dict) -> Column:
            def one(v):
                try:
                    return None if v is None else fn(v, args, options)
                except Exception:  # noqa: BLE001  a step's failure is a null with a warning
                    return None

            @F.pandas_udf(kind or T.StringType())
            def run(values: pd.Series) -> pd.Series:
                return values.astype(object).where(values.notna(), None).map(one)

            return run(value)

        register_transform(name, kind)(column)
        return fn

    return add


def transform(name: str) -> Callable:
    if name not in _TRANSFORMS:
        raise PresetError(f"no transform {name!r}")
    return _TRANSFORMS[name]


def unregister(name: str) -> None:
    _TRANSFORMS.pop(name, None)
