"""Two-digit rounding with the result of Python's ``round(x, 2)``."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# From here on the next double is more than half a hundredth away, so every value rounds to itself.
_EXACT_BELOW = float(1 << 46)
# 2**27 + 1 splits a double into two halves of 26 bits.
_SPLIT = 134217729.0


def _rounded(x: Column, product: Column) -> Column:
    high = x * F.lit(_SPLIT) - (x * F.lit(_SPLIT) - x)
    lost = (high * F.lit(100.0) - product) + (x - high) * F.lit(100.0)
    # The exact value is whole + part + lost; whole is even where the product sits on a half.
    whole = F.rint(product)
    part = product - whole
    side = F.signum(part)
    # On a half the lost bits decide; without any it is a true tie and stays even.
    beyond = (F.abs(part) == 0.5) & (F.signum(lost) == side)
    # Among the largest products all are whole, and the lost bits alone may reach a half.
    odd = F.pmod(whole, F.lit(2.0)) == 1.0
    apart = (part == 0.0) & ((F.abs(lost) > 0.5) | ((F.abs(lost) == 0.5) & odd))
    moved = whole + F.when(beyond, side).when(apart, F.signum(lost)).otherwise(F.lit(0.0))
    return F.when(F.abs(x) < _EXACT_BELOW, moved / F.lit(100.0) + F.lit(0.0)).otherwise(x)


def round2(x: Column) -> Column:
    """Round to 2 digits on the exact binary value, ties to even.

    ``x * 100`` loses its last bits in floating point. The lost part is
    recovered by an exact product split and decides the cases where the rounded
    product sits on a half. Infinity, NaN and null pass through. ``x`` should be a
    plain column; use ``with_rounded`` for expressions, which would be repeated here.
    """
    x = x.cast("double")
    return _rounded(x, x * F.lit(100.0))


def with_rounded(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add the rounded value of each expression, which is computed once."""
    raw = df.withColumns({f"_x_{out}": x.cast("double") for out, x in columns.items()})
    scaled = raw.withColumns({f"_p_{out}": F.col(f"_x_{out}") * F.lit(100.0) for out in columns})
    told = scaled.withColumns(
        {out: _rounded(F.col(f"_x_{out}"), F.col(f"_p_{out}")) for out in columns}
    )
    return told.drop(*[f"_x_{out}" for out in columns], *[f"_p_{out}" for out in columns])
