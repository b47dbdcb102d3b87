"""Column names and column selection."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def snake_case(name: str) -> str:
    """``Master.Number`` and ``masterNumber`` both become ``master_number``."""
    name = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name.replace("%", "_percent_").replace("#", "_number_"))
    name = re.sub(r"[^A-Za-z0-9]+", "_", name).strip("_").lower()
    if not name:
        return "x"
    return f"x{name}" if name[0].isdigit() else name


def clean_names(df: DataFrame) -> DataFrame:
    """Snake-case every column; repeated names get ``_2``, ``_3``, ..."""
    seen: dict[str, int] = {}
    out = []
    for column in df.columns:
        base = snake_case(column)
        seen[base] = seen.get(base, 0) + 1
        out.append(base if seen[base] == 1 else f"{base}_{seen[base]}")
    return df.toDF(*out)


def pick(
    df: DataFrame,
    *names: str,
    starts_with: str | None = None,
    ends_with: str | None = None,
    contains: str | None = None,
    between: tuple[str, str] | None = None,
    drop: Iterable[str] = (),
) -> DataFrame:
    """Select by name, prefix, suffix, substring or range, each once and in the order asked for."""
    chosen = list(names)
    if between:
        first, last = (df.columns.index(c) for c in between)
        chosen += df.columns[first : last + 1]
    for column in df.columns:
        if (
            (starts_with and column.startswith(starts_with))
            or (ends_with and column.endswith(ends_with))
            or (contains and contains in column)
        ):
            chosen.append(column)
    dropped = set(drop)
    return df.select(*[c for c in dict.fromkeys(chosen) if c not in dropped])


def suffix_columns(df: DataFrame, suffix: str, keep: Iterable[str] = ()) -> DataFrame:
    """Add ``suffix`` to every column not in ``keep``."""
    kept = set(keep)
    return df.select(*[F.col(c) if c in kept else F.col(c).alias(c + suffix) for c in df.columns])


def across(df: DataFrame, columns: Iterable[str], fn: Callable[[Column], Column]) -> DataFrame:
    """Apply one column function to several columns in place."""
    return df.withColumns({c: fn(F.col(c)) for c in columns})
