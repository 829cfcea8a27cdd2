"""Column functions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelloom.config import TOLERANCE


def parse_date(c: Column) -> Column:
    """A date from ISO, slashed or compact text; null if it is none."""
    text = F.trim(c.cast("string"))
    return F.coalesce(F.try_to_date(text, "yyyy-MM-dd"), F.try_to_date(text, "yyyy/MM/dd"), F.try_to_date(text, "yyyyMMdd"))


def finite(c: Column) -> Column:
    """A double, null where the value is no number, NaN or infinite."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def clean_text(c: Column) -> Column:
    return F.nullif(F.trim(c.cast("string")), F.lit(""))


def file_date(c: Column) -> Column:
    return F.date_format(c, "yyyy_MM_dd")


def fifteen_digits(c: Column) -> Column:
    """Text of a number with 15 significant digits at most (for sinks only): plain from 0.0001 up to 15
    digits before the point, else with an exponent; no zeros at the end of a fraction. The shortest text
    that tells the number from others is rounded, half up."""
    e = F.format_string("%.14e", c)
    sign = F.when(e.startswith("-"), F.lit("-")).otherwise(F.lit(""))
    digits = F.regexp_replace(F.substring_index(e, "e", 1), "[-.]", "")
    power = F.substring_index(e, "e", -1).cast("int")
    bare = lambda text: F.regexp_replace(text, r"(\.\d*?)0+$", "$1")
    whole = F.concat(F.substr(digits, F.lit(1), power + 1), F.lit("."), F.substr(digits, power + 2, F.lit(15)))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    far = F.concat(F.rtrim(bare(F.concat(F.substr(digits, F.lit(1), F.lit(1)), F.lit("."), F.substr(digits, F.lit(2), F.lit(14)))), F.lit(".")), F.lit("e"), F.substring_index(e, "e", -1))
    plain = F.when(power >= 0, F.rtrim(bare(whole), F.lit("."))).otherwise(F.rtrim(bare(small), F.lit(".")))
    return F.when(c == 0, F.lit("0")).otherwise(F.concat(sign, F.when(power.between(-4, 14), plain).otherwise(far)))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero or either is null."""
    return a / F.nullif(b, F.lit(0.0))


def keep_count(n: Column, share: float | Column) -> Column:
    """How many of n a share keeps: rounded up, one at least (none of none)."""
    return F.when(n > 0, F.greatest(F.lit(1), F.ceil(n * (share if isinstance(share, Column) else F.lit(share)) - F.lit(TOLERANCE)))).otherwise(0).cast("int")


def yes_no(c: Column) -> Column:
    return F.when(c, F.lit("是")).otherwise(F.lit("否"))


#: Labels of the factors in reports (fixed values).
FACTOR_LABELS = {"return_r2": "收益率×R平方", "return_vol": "收益率÷波动率"}
SCORE_COLUMNS = {"return_r2": "return_r2", "return_vol": "return_vol"}


def factor_label(column: Column) -> Column:
    """Report label of a factor's name; another name is an error when it is met."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in FACTOR_LABELS.items() for x in pair]), column), F.raise_error(F.concat(F.lit("unknown factor "), column)))
