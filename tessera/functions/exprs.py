"""Formulas as SQL text in layers: Spark evaluates them as columns, and the same layers render
to one SELECT for any other engine.  Missing is NULL; a ratio with a zero denominator is NULL."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Column names that are words of the other dialect's grammar.
RESERVED = re.compile(r'(?<!")\b(at)\b(?!")')
#: An expression, or one for each dialect where they differ.
Expr = str | Mapping[str, str]


def text(e: Expr, dialect: str) -> str:
    return e if isinstance(e, str) else e[dialect]


def div(a: str, b: str) -> str:
    return f"(({a}) / nullif({b}, 0))"


def signed_ratio(a: str, b: str) -> str:
    """A ratio for comparisons only: plus or minus a huge number where the denominator is zero."""
    return f"(CASE WHEN ({b}) = 0 THEN CASE WHEN ({a}) > 0 THEN 1e300 WHEN ({a}) < 0 THEN -1e300 END ELSE ({a}) / ({b}) END)"


def flag(condition: str) -> str:
    return f"CAST(CASE WHEN {condition} THEN 1 ELSE 0 END AS INT)"


def safe_log(x: str) -> str:
    return f"(CASE WHEN ({x}) > 0 THEN ln({x}) END)"


def clip(x: str, low: float, high: float) -> str:
    return f"(CASE WHEN ({x}) IS NULL THEN NULL WHEN ({x}) < {low} THEN {low} WHEN ({x}) > {high} THEN {high} ELSE ({x}) END)"


@dataclass(frozen=True)
class Panel:
    """Window vocabulary of an entity-by-time panel."""

    entity: str
    time: str

    @property
    def over(self) -> str:
        return f"PARTITION BY {self.entity} ORDER BY {self.time}"

    def lag(self, x: str, k: int = 1) -> str:
        return f"lag({x}, {k}) OVER ({self.over})"

    def lead(self, x: str, k: int = 1) -> str:
        return f"lead({x}, {k}) OVER ({self.over})"

    def row(self) -> str:
        return f"CAST(row_number() OVER ({self.over}) AS INT)"

    def frame(self, n: int, shift: int = 0) -> str:
        last = "CURRENT ROW" if shift == 0 else f"{shift} PRECEDING"
        return f"({self.over} ROWS BETWEEN {n - 1 + shift} PRECEDING AND {last})"

    def roll(self, f: str, x: str, n: int, least: int, shift: int = 0) -> str:
        """``f`` over n rows that end ``shift`` rows back, if ``least`` of them aren't NULL."""
        w = self.frame(n, shift)
        return f"(CASE WHEN count({x}) OVER {w} >= {least} THEN {f}({x}) OVER {w} END)"

    def roll_skew(self, x: str, n: int, least: int) -> Expr:
        """Bias-adjusted skewness, 0 for a constant window."""
        w = self.frame(n)
        count, flat = f"count({x}) OVER {w}", f"min({x}) OVER {w} = max({x}) OVER {w}"
        adjust = f"sqrt(CAST({count} AS DOUBLE) * ({count} - 1)) / ({count} - 2)"
        gate = f"CASE WHEN {count} >= {max(least, 3)} THEN CASE WHEN {flat} THEN 0.0 ELSE "
        return {"spark": f"({gate}{adjust} * skewness({x}) OVER {w} END END)", "duckdb": f"({gate}skewness({x}) OVER {w} END END)"}

    def running(self, f: str, x: str) -> str:
        return f"{f}({x}) OVER ({self.over} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


class Layers:
    """Named expressions in steps; each step sees the columns of all before it."""

    def __init__(self, *steps: Mapping[str, Expr]):
        self.steps = [dict(s) for s in steps if s]

    def __add__(self, other: Layers) -> Layers:
        return Layers(*self.steps, *other.steps)

    def apply(self, df: DataFrame) -> DataFrame:
        for step in self.steps:
            df = df.withColumns({k: F.expr(text(e, "spark")) for k, e in step.items()})
        return df

    def sql(self, source: str, columns: Iterable[str], dialect: str = "duckdb") -> str:
        have = set(columns)
        for step in self.steps:
            new = [f"{text(e, dialect)} AS {k}" for k, e in step.items() if k not in have]
            old = [f"{text(e, dialect)} AS {k}" for k, e in step.items() if k in have]
            star = "*" + (f" REPLACE ({', '.join(old)})" if old else "")
            source = f"(SELECT {', '.join([star, *new])} FROM {source})"
            have |= set(step)
        return RESERVED.sub(r'"\1"', source)


def rounded(names: Iterable[str], digits: int = 6) -> dict[str, Expr]:
    """Final projection: doubles rounded, no negative zero."""
    # Spark rounds by decimal digits, other engines by the scaled double (``columns.rounded``).
    return {n: {"spark": f"round(CAST({n} AS DOUBLE) * 1e{digits}) / 1e{digits} + 0.0e0", "duckdb": f"round(CAST({n} AS DOUBLE), {digits}) + 0.0e0"} for n in names}
