"""Range filters with an account of every rejection."""

from __future__ import annotations

from dataclasses import dataclass, field
from math import isfinite

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The controls and the filter fields that a screen may name.
CONTROLS = ("as_of", "limit", "sort_by", "sort_desc", "exclude_risk_names", "themes_any", "themes_none", "weights", "name")


class SpecError(ValueError):
    """A screen that names something unknown or malformed."""


def parse_range(raw) -> tuple[float | None, float | None]:
    """Inclusive bounds from a number, a comparison, a pair or a mapping.

    A number is a lower bound; ``>`` counts like ``>=`` and ``<`` like ``<=``.
    """

    def number(x) -> float | None:
        if x is None:
            return None
        if isinstance(x, bool):
            raise SpecError("a boolean is no bound")
        try:
            value = float(x)
        except (TypeError, ValueError) as e:
            raise SpecError(f"not a number: {x!r}") from e
        if not isfinite(value):
            raise SpecError("a bound must be finite")
        return value

    if isinstance(raw, dict):
        if set(raw) - {"min", "max"} or not raw:
            raise SpecError(f"a range has min and max, not {sorted(raw)}")
        low, high = number(raw.get("min")), number(raw.get("max"))
    elif isinstance(raw, list | tuple):
        if len(raw) != 2:
            raise SpecError("a range is a pair")
        low, high = map(number, raw)
        if low is not None and high is not None and low > high:
            raise SpecError(f"{low} is above {high}")
    elif isinstance(raw, str) and raw.strip()[:1] in ("<", ">"):
        text = raw.strip()
        value = number(text.lstrip("<>=").strip())
        low, high = (value, None) if text[0] == ">" else (None, value)
    else:
        low, high = number(raw), None
    if low is None and high is None:
        raise SpecError("a range without a bound")
    return low, high


@dataclass(frozen=True)
class Spec:
    """A validated screen; unknown names are errors, never ignored."""

    filters: dict[str, tuple[float | None, float | None]] = field(default_factory=dict)
    sort_by: str = "score"
    sort_desc: bool = True
    limit: int = 25
    exclude_risk_names: bool = True
    themes_any: tuple[str, ...] = ()
    themes_none: tuple[str, ...] = ()

    @classmethod
    def from_dict(cls, raw: dict, fields: set[str], position_fields: set[str] = frozenset()) -> Spec:
        raw = dict(raw)
        nested = raw.pop("filters", {})
        given = {k: v for k, v in {**{k: v for k, v in raw.items() if k not in CONTROLS}, **nested}.items() if v is not None}
        if unknown := sorted(set(given) - fields):
            raise SpecError(f"unknown fields: {', '.join(unknown)}")
        limit = raw.get("limit", 25)
        if isinstance(limit, bool) or not isinstance(limit, int) or limit <= 0:
            raise SpecError("limit must be a positive whole number")
        sort_by = raw.get("sort_by", "score")
        if sort_by != "score" and sort_by not in fields:
            raise SpecError(f"unknown sort field: {sort_by}")
        if sort_by in position_fields:
            raise SpecError(f"{sort_by} filters but never ranks")
        return cls(
            {k: parse_range(v) for k, v in given.items()}, sort_by, bool(raw.get("sort_desc", True)), limit,
            bool(raw.get("exclude_risk_names", True)), tuple(raw.get("themes_any", ())), tuple(raw.get("themes_none", ())),
        )


#: Fixed markers of risk in a name; case counts, and a missing name passes.
RISK_MARKS = ("ST", "退")


def risk_name(name: Column) -> Column:
    text = F.coalesce(name, F.lit(""))
    return text.contains(RISK_MARKS[0]) | text.contains(RISK_MARKS[1])


def rejection(spec: Spec, columns: list[str]) -> Column:
    """The first reason why a row fails, or NULL: names, themes, then ranges in order.

    Missing values have reasons of their own; a field that the table lacks
    rejects every row.
    """
    tests: list[tuple[Column, str]] = []
    if spec.exclude_risk_names:
        tests.append((risk_name(F.col("name")), "risk name"))
    tags = F.split("theme_tags", r"\|")
    if spec.themes_any:
        tests.append((~F.coalesce(F.arrays_overlap(tags, F.array(*map(F.lit, spec.themes_any))), F.lit(False)), "theme missing"))
    if spec.themes_none:
        tests.append((F.coalesce(F.arrays_overlap(tags, F.array(*map(F.lit, spec.themes_none))), F.lit(False)), "theme excluded"))
    for name, (low, high) in spec.filters.items():
        if name not in columns:
            tests.append((F.lit(True), f"{name}: absent"))
            continue
        value = F.col(name)
        outside = F.lit(False)
        if low is not None:
            outside = outside | (value < low)
        if high is not None:
            outside = outside | (value > high)
        tests += [(value.isNull(), f"{name}: missing"), (outside, f"{name}: out of range")]
    found = F.lit(None).cast("string")
    for test, reason in reversed(tests):
        found = F.when(test, F.lit(reason)).otherwise(found)
    return found


def funnel(rows: DataFrame, spec: Spec) -> DataFrame:
    """``reason, n``: rows per first failing reason; ``kept`` for those that pass."""
    return rows.select(F.coalesce(rejection(spec, rows.columns), F.lit("kept")).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
