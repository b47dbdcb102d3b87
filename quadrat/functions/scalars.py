"""Column helpers for the semantics that differ from plain Spark defaults."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text that stands for a missing cell in the field sheets.
NULL_TOKENS = ["na", "n/a", "u", "?", "unknown"]


def if_else(condition: Column, yes, no) -> Column:
    """Two-way choice that stays null where the condition is null."""
    return F.when(condition, yes).when(~condition, no)


def yes_no(condition: Column) -> Column:
    """Text rendering of a flag; null counts as ``no``."""
    return F.when(condition, F.lit("yes")).otherwise(F.lit("no"))


def first_match(rules: Iterable[tuple[Column, object]], default=None) -> Column:
    """Ordered rules, the first true one decides; null conditions fall through."""
    chain = None
    for condition, outcome in rules:
        value = outcome if isinstance(outcome, Column) else F.lit(outcome)
        chain = F.when(condition, value) if chain is None else chain.when(condition, value)
    fallback = default if isinstance(default, Column) else F.lit(default)
    return fallback if chain is None else chain.otherwise(fallback)


def text_rules(column: Column, rules: Iterable[tuple[str, str, str]], default: str) -> Column:
    """Rules given as data: ``(kind, pattern, outcome)`` with kind ``regex`` or ``equals``."""
    return first_match(
        [
            ((column == pattern) if kind == "equals" else column.rlike(pattern), outcome)
            for kind, pattern, outcome in rules
        ],
        default,
    )


def recode(column: Column, mapping: Mapping[str, str | None]) -> Column:
    """Value map; a value without an entry is kept, an entry of ``None`` blanks it."""
    targets: dict[str | None, list[str]] = {}
    for source, target in mapping.items():
        targets.setdefault(target, []).append(source)
    return first_match([(column.isin(sources), target) for target, sources in targets.items()], column)


def null_tokens(column: Column, tokens: Iterable[str] = NULL_TOKENS) -> Column:
    """Null where the trimmed, lower-cased text is one of the markers."""
    return F.when(~F.lower(F.trim(column)).isin(list(tokens)), column)


def replace_first(column: Column, pattern: str, replacement: str) -> Column:
    """Replace only the first match of ``pattern``."""
    return F.regexp_replace(column, f"(?s)^(.*?)(?:{pattern})", "$1" + replacement)


def null_if_match(column: Column, pattern: str) -> Column:
    """The whole value becomes null when the pattern occurs in it."""
    return F.when(~column.rlike(pattern), column)


def strict_sum(column: Column) -> Column:
    """Sum that is null as soon as one input is null."""
    return F.when(F.count(column) == F.count(F.lit(1)), F.sum(column))


def unite(columns: Iterable[Column], sep: str = "_", skip_null: bool = False) -> Column:
    """Join columns into one text; nulls are written as ``NA`` unless skipped."""
    cols = [c.cast("string") for c in columns]
    return F.concat_ws(sep, *[c if skip_null else F.coalesce(c, F.lit("NA")) for c in cols])


def join_notes(*notes: Column) -> Column:
    """Audit notes in order, blank ones left out, null when there is none."""
    return F.nullif(F.concat_ws(", ", *[F.nullif(F.trim(n), F.lit("")) for n in notes]), F.lit(""))


def packed_date(column: Column, year: int | Column) -> Column:
    """``523`` is 23 May: first digit month, the rest day; null when no such day exists."""
    text = column.cast("string")
    y = year if isinstance(year, Column) else F.lit(year)
    iso = F.concat(
        F.lpad(y.cast("string"), 4, "0"),
        F.lit("-"),
        F.lpad(F.substring(text, 1, 1), 2, "0"),
        F.lit("-"),
        F.lpad(F.substring(text, 2, 8), 2, "0"),
    )
    return F.try_to_date(iso, "yyyy-MM-dd")


def clock_time(column: Column) -> Column:
    """``HH:mm`` of a time stored as a full timestamp or as text with a date in front."""
    return F.nullif(F.regexp_extract(column.cast("string"), r"(\d{2}:\d{2})(?::\d{2})?", 1), F.lit(""))


def date_of_day(day_of_year: Column, year: int | Column) -> Column:
    """Date of a one-based day of the year."""
    y = year if isinstance(year, Column) else F.lit(year)
    return F.date_add(F.make_date(y, F.lit(1), F.lit(1)), day_of_year.cast("int") - 1)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient as double, null when the denominator is zero."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))
