"""Derived features as Column expressions (no Python UDFs).

Each builder takes the column names it reads; absent optional columns are
handled by the DataFrame-level helpers in ``hearth.operators.features``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hearth.schema import BASIC_RULES, SCORE_CAP, SCORE_RULES, score_text

# Reference year of ``house_age`` and the label thresholds.
CURRENT_YEAR = 2025
LUXURY_PRICE = 1_000_000
SIZE_SMALL_BELOW = 1500
SIZE_MEDIUM_BELOW = 3000
LABEL_EXCELLENT, LABEL_GOOD, LABEL_AVERAGE = 80, 60, 40


def price_per_sqft(price: str = "price", sqft: str = "sqft_living", floor: bool = True) -> Column:
    """price / max(sqft, 1). R8: NULL sqft stays NULL (``greatest`` would
    turn it into 1); R9: a zero divisor gives NULL instead of an ANSI error."""
    s = F.col(sqft)
    denom = F.when(s.isNotNull(), F.greatest(s, F.lit(1))) if floor else s
    return F.try_divide(F.col(price).cast("double"), denom.cast("double"))


def house_age(yr_built: str = "yr_built", year: int = CURRENT_YEAR) -> Column:
    return F.lit(year) - F.col(yr_built)


def renovated_flag(col: str = "yr_renovated") -> Column:
    return F.when(F.col(col) > 0, F.lit(1)).otherwise(F.lit(0))


def total_sqft(above: str = "sqft_above", basement: str = "sqft_basement") -> Column:
    return F.col(above) + F.col(basement)


def luxury_flag(price: str = "price", threshold: float = LUXURY_PRICE) -> Column:
    return F.when(F.col(price) > threshold, F.lit(1)).otherwise(F.lit(0))


def size_category(sqft: str = "sqft_living") -> Column:
    """<1500 Small, <3000 Medium, else Large; a missing size falls to Large
    because both comparisons are false, as in the reference."""
    s = F.col(sqft)
    return (F.when(s < SIZE_SMALL_BELOW, F.lit("Small"))
             .when(s < SIZE_MEDIUM_BELOW, F.lit("Medium"))
             .otherwise(F.lit("Large")))


def investment_score_basic(rules=BASIC_RULES) -> Column:
    """The first four rules, without a cap. A NULL comparison gives no points,
    as in the reference (NaN >= x is False)."""
    return F.expr(score_text(rules, None))


def investment_score(columns: list[str], rules=SCORE_RULES, cap: int = SCORE_CAP) -> Column:
    """Points of all rules, capped; a rule whose column is absent from
    ``columns`` contributes 0."""
    return F.expr(score_text([r for r in rules if r[0] in columns], cap))


def investment_label(score: str = "investment_score") -> Column:
    s = F.col(score)
    return (F.when(s >= LABEL_EXCELLENT, F.lit("Excellent"))
             .when(s >= LABEL_GOOD, F.lit("Good"))
             .when(s >= LABEL_AVERAGE, F.lit("Average"))
             .otherwise(F.lit("Risky")))


# Value-driver messages.
DRIVER_WATERFRONT = "Waterfront property increases value."
DRIVER_GRADE = "High construction quality detected."


def value_drivers(waterfront: str = "waterfront", grade: str = "grade") -> Column:
    """Messages that apply to the row, joined by ' ' (empty when none)."""
    arr = F.array_compact(F.array(
        F.when(F.col(waterfront) == 1, F.lit(DRIVER_WATERFRONT)),
        F.when(F.col(grade) >= 8, F.lit(DRIVER_GRADE))))
    return F.array_join(arr, " ")


def value_score(price: str = "price", sqft: str = "sqft_living") -> Column:
    return F.try_divide(F.col(sqft).cast("double"), F.col(price).cast("double")) * 100000.0


def heat_weight(price: str = "price") -> Column:
    return F.col(price) / 1e6


def dollars(col: Column) -> Column:
    """``$1,234`` (no decimals)."""
    return F.concat(F.lit("$"), F.format_number(col, 0))


def percent(col: Column, decimals: int = 2) -> Column:
    return F.concat(F.format_number(col, decimals), F.lit("%"))


def feature_title(col: Column) -> Column:
    """``sqft_living`` -> ``Sqft Living``."""
    return F.initcap(F.regexp_replace(col, "_", " "))
