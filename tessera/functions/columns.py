"""Column helpers under the NULL contract: missing is NULL, never NaN; infinities are missing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, NumericType


def clean(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def clean_frame(df: DataFrame) -> DataFrame:
    """NaN and infinities of every floating column to NULL."""
    return df.withColumns({f.name: clean(F.col(f.name)) for f in df.schema if isinstance(f.dataType, (DoubleType, FloatType))})


def rounded(x: Column, digits: int) -> Column:
    """Rounded as other engines do, by the scaled double: 60.84124999999999 times 10,000 is 608412.5.
    Spark's own ``round`` goes by the decimal digits, which differ at such ties."""
    scale = F.lit(float(10**digits))
    return F.round(x.cast("double") * scale) / scale


def ieee_ratio(a: Column, b: Column) -> Column:
    """a / b as SQL engines without the NULL contract have it: infinite or NaN where b is zero."""
    zero = F.when(F.isnan(a) | (a == 0), float("nan")).when(a > 0, float("inf")).when(a < 0, float("-inf"))
    return F.when(b == 0, zero).otherwise(F.try_divide(a, b))


def ieee_log(x: Column) -> Column:
    """Logarithm that is minus infinity at zero."""
    return F.when(x == 0, float("-inf")).otherwise(F.log(x))


def to_int(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("int")


def clip(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def number(x: Column) -> Column:
    return x.try_cast("double")


def forward_fill(x: str, entity: str, time: str) -> Column:
    from pyspark.sql import Window

    return F.last(x, ignorenulls=True).over(Window.partitionBy(entity).orderBy(time).rowsBetween(Window.unboundedPreceding, 0))


def back_fill(x: str, entity: str, time: str) -> Column:
    """Takes values from the future: use on purpose only."""
    from pyspark.sql import Window

    return F.first(x, ignorenulls=True).over(Window.partitionBy(entity).orderBy(time).rowsBetween(0, Window.unboundedFollowing))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def unit(v: Column, eps: float = 1e-8) -> Column:
    return let(v, lambda u: let(norm(u) + eps, lambda n: F.transform(u, lambda x: x / n)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row, however often the body uses it; inside a
    lambda function an expression would be computed for each element."""
    return F.transform(F.array(value), body)[0]


def softmax(v: Column) -> Column:
    def shares(e: Column) -> Column:
        return let(F.aggregate(e, F.lit(0.0), lambda s, y: s + y), lambda total: F.transform(e, lambda x: x / total))

    return let(v, lambda u: let(F.array_max(u), lambda top: let(F.transform(u, lambda x: F.exp(x - top)), shares)))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (1.0 + F.exp(-x))


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def argmax(v: Column) -> Column:
    return F.array_position(v, F.array_max(v)) - 1


def window_vectors(x: str, entity: str, time: str, size: int) -> Column:
    """The last ``size`` values as an array, NULL until there are that many."""
    from pyspark.sql import Window

    w = Window.partitionBy(entity).orderBy(time).rowsBetween(1 - size, 0)
    held = F.collect_list(x).over(w)
    return F.when(F.size(held) == size, held)


def zscore_vector(v: Column, eps: float = 1e-8) -> Column:
    n = F.size(v).cast("double")
    mean = F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / n

    def scaled(m: Column) -> Column:
        sd = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)) / (n - 1))
        return let(sd, lambda d: F.transform(v, lambda x: (x - m) / (d + eps)))

    return let(mean, scaled)


def feature_columns(df: DataFrame, keys: set[str]) -> list[str]:
    """Numeric columns but for keys, targets and join leftovers."""
    return [f.name for f in df.schema if isinstance(f.dataType, NumericType) and f.name not in keys and not f.name.endswith(("_x", "_y"))]


def encode_ple(x: Column, bins: int = 64, low: float = -4.0, high: float = 4.0) -> Column:
    """Piecewise-linear encoding: for each bin how far x has filled it, from 0 to 1."""
    width = (high - low) / bins
    return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.least(F.greatest((x - (low + i * width)) / width, F.lit(0.0)), F.lit(1.0)))
