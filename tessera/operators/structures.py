"""Chemistry kernels behind one interface: structure functions need a toolkit that need not be installed.

A kernel maps a structure text to a value; register one by name and apply it as a
Pandas UDF. Rows whose kernel fails say so and do not stop the others.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_KERNELS: dict[str, tuple[Callable, str]] = {}


def register(name: str, kernel: Callable, kind: str) -> None:
    _KERNELS[name] = (kernel, kind)


def known() -> list[str]:
    return sorted(_KERNELS)


def apply(name: str, column: Column) -> Column:
    """A struct of value and error: a kernel's failure marks its row alone and says why; null stays null without an error.

    Kernels are called once for each distinct structure of a batch.
    """
    if name not in _KERNELS:
        raise KeyError(f"no kernel {name!r}; known: {sorted(_KERNELS)}")
    kernel, kind = _KERNELS[name]

    def one(x):
        if x is None:
            return None, None
        try:
            return kernel(x), None
        except Exception as e:  # noqa: BLE001 - the row says what went wrong
            return None, f"{type(e).__name__}: {e}"[:500]

    @F.pandas_udf(f"value {kind}, error string")
    def run(s: pd.Series) -> pd.DataFrame:
        found = {x: one(x) for x in s.dropna().unique()}
        pairs = [found.get(x, (None, None)) if x is not None else (None, None) for x in s]
        return pd.DataFrame({"value": pd.Series([v for v, _ in pairs], dtype=object), "error": pd.Series([e for _, e in pairs], dtype=object)})

    return run(column)


def stereo_markers(column: Column) -> Column:
    """How many stereo marks a line notation holds."""
    return F.length(column) - F.length(F.regexp_replace(column, r"[@/\\]", ""))


def has_stereo(column: Column) -> Column:
    return column.rlike(r"[@/\\]")
